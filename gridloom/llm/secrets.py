"""Secret scans through nested encodings: a worklist of decoded layers, rescanned until a fixpoint.

The base patterns run over each whole text.  Then a worklist holds layers of the text: percent
escapes and Unicode escapes are decoded in place, base64 tokens become layers of their own, and
gzip or zlib data is inflated, be it in base64 or spelt in percent or byte escapes.  A layer whose
text was seen before is not entered again (cycles end there), every new layer is scanned, and its
findings are mapped back to code points of the original text.  A layer is accepted only if it
decodes to text (valid UTF-8 of few control characters), so ordinary long words do not open layers.
Base64 is read across line ends, over any number of lines of any width, and where it does not open as a
whole, between ``/``, ``-`` and ``_``.  Decoded layers add spans; base spans stay.

Escapes are decoded layer by layer to a depth of ``STEPS``; whatever is nested deeper is decoded to its
end in one pass with a stack, so the time is linear in the text.  Layers keep their way back as
composed arrays of edges.  Inflated data up to ``WHOLE`` bytes is a layer; more of it is read as a stream
and cut where nothing that could be found can go across, so its parts hold what the whole holds (see
``safe_cut`` and ``line_cut``).  A part is as long as the text goes on without such a place; a base64 run that stands
alone in it is kept compressed and read as a stream of its own.  Findings map to the token they are in.

Null texts count as empty, an empty table gives no rows.  Each row is scanned by itself, so order, ties
and repeats do not matter; columns other than the text pass through.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import hashlib
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import common as C

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPES = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
LEAST = 16  # characters of a base64 token
STEPS = 3  # layers of escapes that are decoded one by one
PIECE, WHOLE = 1 << 20, 4 << 20  # bytes of inflated data at once, and in a layer
CHUNK = 1 << 16  # bytes that go from one compressed layer of a stream to the next
LEVELS = 64  # compressed layers inside each other after which a stream is looked at for one that holds itself
BASE64 = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}")
#: Runs parted by line ends only, from the first run's start on.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[\x20\t]*+\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)++={0,2}")
RUN = re.compile(r"[A-Za-z0-9+/_-]+")
EDGE = re.compile(r"[/_-]")
RUN_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: What no escape, no compressed data in escapes and no base pattern goes across.
HARD = re.compile(r"[^\x20-\x7E]")
#: Escapes, and what compressed data in escapes can begin with, which may go on to the next ``HARD`` character.
CODED = re.compile(r"%[0-9A-Fa-f]{2}|\\[xuU][0-9A-Fa-f]|&#[0-9xX]|x\^")
#: Where nothing goes across unless something is ``CODED`` before it: marks, and spaces but next to ``:`` or ``=``.
GAP = re.compile(r"[!$()*,<>?@\[\]`{|}~]|(?<=[!-9;<>-~])\x20+(?=[!-$'-\[\]-~])")
KEY_END = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\Z""", re.I | re.A)
SPACES = re.compile(r"\x20{3,}")
FEW = 64  # beginnings that are looked at one by one before whole arrays are
#: Compressed data in escapes: its first two bytes, and what its bytes can be spelt as.
PERCENT_DATA = (re.compile(r"(?:%1[Ff]%8[Bb]|(?:x|%78)%(?:01|5[Ee]|9[Cc]|[Dd][Aa]))"), re.compile(r"%([0-9A-Fa-f]{2})|([A-Za-z0-9_.~!*'()/+:@$,;-])"))
ESCAPED_DATA = (
    re.compile(r"(?:\\(?:x|u00)1[Ff]\\(?:x|u00)8[Bb]|(?:x|\\(?:x|u00)78)(?:\^|\\(?:x|u00)(?:01|5[Ee]|9[Cc]|[Dd][Aa])))"),
    re.compile(r"\\(?:x|u00)([0-9A-Fa-f]{2})|([\x20-\x5B\x5D-\x7E])|\\([abfnrtv0\\'\"])"),
)
NAMED = dict(zip("abfnrtv0\\'\"", "\a\b\f\n\r\t\v\0\\'\"", strict=True))
CONTROLS = re.compile(r"[\x00-\x08\x0E-\x1F\x7F-\x9F]")
ASCII_CONTROLS = bytes([*range(9), *range(14, 32), 127])

Span = tuple[int, int, int]  # start, index of its kind, end
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))


def scan(text: str) -> list[Span]:
    """The base patterns' findings, leftmost and non-overlapping for each kind."""
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A text with the way back to the original's code points: segments that begin at ``here`` and came
    from ``a`` to ``b`` there, character by character (``plain``) or as a whole."""

    def __init__(self, text: str, here: list[int], a: list[int], b: list[int], plain: list[bool], steps: int = 0):
        self.text, self.here, self.a, self.b, self.plain, self.steps = text, here, a, b, plain, steps

    def back(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self.here, start) - 1, bisect_right(self.here, max(start, end - 1)) - 1
        first = self.a[i] + start - self.here[i] if self.plain[i] else self.a[i]
        return first, self.a[j] + end - self.here[j] if self.plain[j] else self.b[j]


def whole_layer(text: str) -> Layer:
    return Layer(text, [0], [0], [len(text)], [True])


class Builder:
    """A layer in the making, from parts of another one in order."""

    def __init__(self, layer: Layer):
        self.layer, self.parts, self.size, self.at = layer, [], 0, 0
        self.here, self.a, self.b, self.plain = [], [], [], []

    def keep(self, start: int, end: int) -> None:
        """The other layer's text from start to end as it is."""
        own = self.layer
        if start >= end:
            return
        while self.at + 1 < len(own.here) and own.here[self.at + 1] <= start:
            self.at += 1
        k = self.at
        while k < len(own.here) and own.here[k] < end:
            x = max(start, own.here[k])
            self.here.append(self.size + x - start)
            self.a.append(own.a[k] + x - own.here[k] if own.plain[k] else own.a[k])
            self.b.append(own.b[k])
            self.plain.append(own.plain[k])
            k += 1
        self.parts.append(own.text[start:end])
        self.size += end - start

    def put(self, text: str, start: int, end: int) -> None:
        """Other text in place of the part from start to end."""
        if not text:
            return
        first, last = self.layer.back(start, end)
        self.here.append(self.size)
        self.a.append(first)
        self.b.append(last)
        self.plain.append(False)
        self.parts.append(text)
        self.size += len(text)

    def layer_of(self, steps: int) -> Layer | None:
        return Layer("".join(self.parts), self.here, self.a, self.b, self.plain, steps) if self.here else None


def in_place(layer: Layer, pattern: re.Pattern, decode: Callable[[str], str]) -> Layer | None:
    """The layer with each escape decoded once."""
    new, at = Builder(layer), 0
    for m in pattern.finditer(layer.text):
        new.keep(at, m.start())
        new.put(decode(m[0]), m.start(), m.end())
        at = m.end()
    if not at:
        return None
    new.keep(at, len(layer.text))
    return new.layer_of(layer.steps + 1)


HEX_DIGITS = frozenset("0123456789abcdefABCDEF")
RAW = re.compile("[\udc80-\udcff]+|[\ud800-\udbff]")


def settled(layer: Layer) -> Layer | None:
    """The layer with all escapes decoded, and those that their results form, however deep: characters
    go onto a stack, and an escape at its top is at once replaced by what it stands for.  Bytes beyond
    ASCII wait as lone surrogates until their neighbours are known."""
    out: list[str] = []
    starts: list[int] = []
    ends: list[int] = []

    def value(k: int) -> str | None:
        """What the last k characters stand for, if they are an escape."""
        if len(out) < k:
            return None
        head, rest = out[-k], out[1 - k :]
        if k == 3 and head == "%":
            code = int("".join(rest), 16)
        elif head == "\\" and rest[0] == {4: "x", 6: "u", 10: "U"}.get(k) and all(c in HEX_DIGITS for c in rest[1:]):
            code = int("".join(rest[1:]), 16)
            if k > 4:
                if k == 6 and 0xDC00 <= code < 0xE000 and len(out) > 6 and "\ud800" <= out[-7] < "\udc00":
                    return f"\ud800{chr(0x10000 + (ord(out[-7]) - 0xD800) * 1024 + code - 0xDC00)}"  # with the unit before
                return chr(code) if code < 0xDC00 or 0xE000 <= code < 0x110000 else "\ufffd"
        else:
            return None
        return chr(code) if code < 128 else chr(0xDC00 + code)

    def entity() -> tuple[int, str] | None:
        for k in range(4, min(len(out), 11) + 1):
            if out[-k] == "&":
                m = re.fullmatch(r"&#(?:([0-9]{1,7})|[xX]([0-9A-Fa-f]{1,6}));", "".join(out[-k:]))
                if m is None:
                    return None
                code = int(m[1]) if m[1] else int(m[2], 16)
                return k, chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"
        return None

    found = False
    for i, c in enumerate(layer.text):
        out.append("\ufffd" if "\ud800" <= c < "\ue000" else c)
        starts.append(i)
        ends.append(i + 1)
        while True:
            new, k = None, 0
            if out[-1] in HEX_DIGITS:
                if len(out) > 2 and out[-3] == "%" and out[-2] in HEX_DIGITS:
                    k = 3
                    new = value(3)
                else:
                    for k in (4, 6, 10):
                        if len(out) >= k and out[-k] == "\\" and (new := value(k)) is not None:
                            break
            elif out[-1] == ";" and (got := entity()) is not None:
                k, new = got
            if new is None:
                break
            found = True
            if len(new) == 2:  # a pair of units
                k, new = 7, new[1]
            first, last = starts[-k], ends[-1]
            del out[-k:], starts[-k:], ends[-k:]
            out.append(new)
            starts.append(first)
            ends.append(last)
    if not found:
        return None
    new, text, at = Builder(layer), "".join(out), 0
    marks = [m.span() for m in RAW.finditer(text)]
    for x, y in [*marks, (len(text), len(text))]:
        k = at
        while k < x:  # runs that stayed as they are, and decoded characters
            if ends[k] - starts[k] > 1:
                new.put(out[k], starts[k], ends[k])
                k += 1
                continue
            j = k
            while j < x and ends[j] - starts[j] == 1:
                j += 1
            new.keep(starts[k], ends[j - 1])
            k = j
        if x < y:
            new.put(bytes(ord(c) - 0xDC00 for c in out[x:y]).decode("utf-8", "replace") if out[x] >= "\udc80" else "\ufffd", starts[x], ends[y - 1])
        at = y
    return new.layer_of(layer.steps + 1)


def unpercent(run: str) -> str:
    return bytes.fromhex(run.replace("%", "")).decode("utf-8", "replace")


def unescape(run: str) -> str:
    if run[:2] == "\\u":
        return bytes.fromhex(run.replace("\\u", "")).decode("utf-16-be", "replace")
    if run[:2] == "\\x":
        return bytes.fromhex(run.replace("\\x", "")).decode("utf-8", "replace")
    code = int(run[2:], 16) if run[0] == "\\" else int(run[3:-1], 16) if run[2] in "xX" else int(run[2:-1])
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"


def readable(data: bytes) -> str | None:
    """The data as text, if it is text: valid UTF-8, at most a quarter of it control characters."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return text if text and 4 * len(CONTROLS.findall(text)) <= len(text) else None


def compressed(data: bytes) -> bool:
    return data[:2] == b"\x1f\x8b" or data[:1] == b"\x78" and len(data) > 2 and (data[0] * 256 + data[1]) % 31 == 0


def inflate_pieces(data: bytes) -> Iterator[bytes]:
    """What gzip (all members) or zlib data holds, in bounded pieces; the generator's value is how many
    bytes it takes.  Raises ``zlib.error`` if not even the first member can be read."""
    members, rest = 0, data
    while not members or rest[:2] == b"\x1f\x8b":
        machine, left = zlib.decompressobj(47), rest
        try:
            while not machine.eof:
                piece = machine.decompress(left, PIECE)
                left = machine.unconsumed_tail
                if piece:
                    yield piece
                elif not left:
                    break
        except zlib.error:
            if not members:
                raise
            break
        members += 1
        rest = machine.unused_data
    return len(data) - len(rest)


def unpacked(data: bytes) -> tuple[bytes | None, int] | None:
    """What gzip or zlib data holds (None where it is over ``WHOLE`` bytes) and how many bytes it takes;
    None for anything else."""
    if not compressed(data):
        return None
    parts, size, source = [], 0, inflate_pieces(data)
    while True:
        try:
            piece = next(source)
        except StopIteration as end:
            return b"".join(parts) if size <= WHOLE else None, end.value
        except zlib.error:
            return None
        size += len(piece)
        if size <= WHOLE:
            parts.append(piece)
        else:
            parts.clear()


class Flood:
    """Text too long to be a layer: the kinds that are found in it, window by window."""

    def __init__(self, kinds: set[int]):
        self.kinds = kinds


def plain(data: bytes) -> str | Flood | None:
    """The text in some bytes, through any compressed layers in between."""
    seen: set[bytes] = set()
    while (inner := unpacked(data)) is not None:
        if inner[0] is None:
            return flood(partial(chunks, data))
        key = hashlib.sha1(data).digest()
        if key in seen:
            return None
        seen.add(key)
        data = inner[0]
    return readable(data)


class NotPacked(zlib.error):
    """The data of a level only begins like compressed data."""

    def __init__(self, level: int):
        super().__init__(level)
        self.level = level


class Deep(zlib.error):
    """There are more levels than asked for."""


def chunks(data: bytes) -> Iterator[bytes]:
    return (data[x : x + CHUNK] for x in range(0, len(data), CHUNK))


def deepest(source: Iterator[bytes], limit: int | None = None, bound: int = LEVELS, hashes: list | None = None) -> Iterator[bytes]:
    """Pieces of what is in a stream of pieces, through all compressed layers in between.

    The data of level ``limit`` is what is asked for even if it begins like compressed data.  ``hashes`` gets
    the hash of each level's data, which is then read to its end.
    """
    heads, machines, members, over = [b""], [None], [0], [False]
    last, work = None, []
    if hashes is not None:
        hashes.append(hashlib.sha1())
    for chunk in source:
        work.append((0, chunk))
        if hashes is not None:
            hashes[0].update(chunk)
        while work:
            k, data = work.pop()
            if over[k]:
                continue
            if k == last:
                yield data
                continue
            if (machine := machines[k]) is None:  # a member begins
                data = heads[k] + data
                if len(data) < 3:
                    heads[k] = data
                    continue
                heads[k] = b""
                if not members[k]:
                    if k == limit or not compressed(data):
                        last = k
                        yield data
                        continue
                    if k == bound:
                        raise Deep
                    for own, value in ((heads, b""), (machines, None), (members, 0), (over, False)):
                        own.append(value)
                    if hashes is not None:
                        hashes.append(hashlib.sha1())
                elif data[:2] != b"\x1f\x8b":
                    over[k] = True
                if not over[k]:
                    machine = machines[k] = zlib.decompressobj(47)
            if not over[k]:
                try:
                    piece = machine.decompress(data, CHUNK)
                except zlib.error:
                    if not members[k]:
                        raise NotPacked(k) from None
                    over[k] = True
            if over[k]:
                if hashes is None:
                    return
                continue
            left = machine.unused_data if machine.eof else machine.unconsumed_tail
            if machine.eof:
                machines[k] = None
                members[k] += 1
            if left or piece and not machine.eof:
                work.append((k, left))
            if piece:
                work.append((k + 1, piece))
                if hashes is not None:
                    hashes[k + 1].update(piece)
    if last is None and heads[-1] and not members[-1]:
        yield heads[-1]


def holds_itself(source: Iterator[bytes], bound: int) -> bool:
    """Whether one of the first levels of compressed data is another one again, so that they never end."""
    hashes: list = []
    for _ in deepest(source, bound, bound, hashes):
        pass
    return len({h.digest() for h in hashes}) < len(hashes)


def flood(source: Callable[[], Iterator[bytes]]) -> Flood | None:
    """The kinds in text of any length, through any compressed layers in between, or None if it is no text.
    ``source`` gives the pieces anew with each call."""
    limit, bound = None, LEVELS
    while True:
        try:
            try:
                return kinds_in(deepest(source(), limit, bound))
            except Deep:
                if holds_itself(source(), bound):
                    return None
                bound *= 2
        except NotPacked as e:
            limit = e.level
        except UnicodeDecodeError:
            return None


def control_count(text: str) -> int:
    return len(text) - len(text.encode().translate(None, ASCII_CONTROLS)) if text.isascii() else len(CONTROLS.findall(text))


def gap_cut(window: str, start: int, end: int) -> int:
    """The last ``GAP`` of a stretch without ``HARD`` characters that nothing goes across, or 0."""
    if (m := CODED.search(window, start, end)) is not None:
        end = m.start()
    right, step = end, 1 << 12
    while right > start:
        left = max(start, right - step)
        for m in reversed(list(GAP.finditer(window, left, right))):
            if not (m[0][0] == " " and KEY_END.search(window, max(0, m.start() - 10), m.start())):
                return m.start()
        right, step = left, 2 * step
    return 0


def safe_cut(window: str) -> int:
    """The last place that nothing goes across which could be found in the text or any layer of it, or 0.

    Only base64 goes over line ends, and only from a line's last character to the next one's first; only
    compressed data in escapes and an assignment go across other marks and spaces.  Escapes are looked
    for wherever they could decode to what goes on.
    """
    if not window:
        return 0
    if HARD.match(window[-1]) and window[-1] not in "\t\r\n":
        return len(window)
    right, low, step = len(window), len(window), 1 << 14
    while low:
        high, low = low, max(0, low - step)
        step *= 2
        for m in reversed(list(HARD.finditer(window, low, high))):
            at = m.start()
            if cut := gap_cut(window, at + 1, right):
                return cut
            if m[0] not in "\t\r\n":
                return at + 1
            first, end = at, at + 1
            while first and window[first - 1] in "\x20\t\r\n":
                first -= 1
            while end < len(window) and window[end] in "\x20\t\r\n":
                end += 1
            apart = window.count("\n", first, end) > 1 or window[first - 1] not in RUN_CHARS + ";" or end < len(window) and window[end] not in RUN_CHARS + "%\\&"
            if first and apart:
                return first
            right = at
    return gap_cut(window, 0, right)


def inflates_until(data: bytes, start: int) -> int:
    """Up to where compressed data that begins at ``start`` may go on, or a little more."""
    machine = zlib.decompressobj(47)
    for at in range(start, len(data), 256):
        left = data[at : at + 256]
        try:
            while left and not machine.eof:
                machine.decompress(left, PIECE)
                left = machine.unconsumed_tail
        except zlib.error:
            return at + 256
        if machine.eof:
            end = min(at + 256, len(data)) - len(machine.unused_data)
            return len(data) if end + 2 > len(data) or data[end : end + 2] == b"\x1f\x8b" else end + 2
    return len(data)


def line_cut(window: str) -> int:
    """In base64 runs on lines, the last line end that no range goes across which may open, or 0.

    A range is taken to go on until it is neither UTF-8 nor compressed data, and over the end if it gets there.
    """
    m = None
    for m in WRAPPED.finditer(window):  # noqa: B007 (the last)
        pass
    if m is None or CODED.search(window, 0, m.end()):
        return 0
    runs = RUN.findall(m[0])
    body, begins = "".join(runs), [0, *accumulate(map(len, runs))]
    firsts = np.array(sorted({*begins[:-1], *(e.end() for e in EDGE.finditer(body))} - {len(body)}))
    over = np.zeros(len(body) + 2, np.int64)  # ranges that begin or end at each place
    for phase in range(4):
        data = bytes_of(body[phase : len(body) - ((len(body) - phase) % 4 == 1)]) or b""
        n = len(data)
        inner, bad, _ = characters(data)
        own = firsts[(firsts % 4 == phase) & (firsts >= phase)]
        at = (own - phase) // 4 * 3
        stop = np.append(bad, n)[np.searchsorted(bad, at)]
        stop[stop >= n - 4] = n  # more may make a character of it
        head = np.frombuffer(data + bytes(16), np.uint8)[at[:, None] + np.arange(2)].astype(np.int64) @ [256, 1]
        live = ((stop == n) | (stop - at >= LEAST * 3 // 4)) & ~np.append(inner, np.zeros(16, bool))[at]
        stop[~live] = 0
        for k in np.flatnonzero((head == 0x1F8B) | (head >> 8 == 0x78) & (head % 31 == 0)).tolist():
            stop[k] = max(stop[k], inflates_until(data, int(at[k])))
        live = stop > 0
        np.add.at(over, own[live] + 1, 1)
        np.add.at(over, np.where(stop[live] >= n, len(body) + 1, np.minimum(phase - (-stop[live] * 4 // 3) + 4, len(body) + 1)), -1)
    free = np.flatnonzero(np.cumsum(over)[begins[1:-1]] == 0)
    if not len(free):
        return 0
    ends = [r.end() for r in RUN.finditer(m[0])]
    return m.start() + ends[int(free[-1])]


def lone_run(window: str) -> int | None:
    """Where the base64 run at the window's end begins, if it is long and nothing before it goes on in it."""
    start = len(window.rstrip(RUN_CHARS))
    if len(window) - start < PIECE:
        return None
    before = window[:start]
    own = before.rstrip("\x20\t\r")
    word = own[max(own.rfind(c) for c in "\x20\t\n") + 1 :]
    if before[-1:] in ("%", "\\", ";", "#", "&") or own[-1:] == "\n" or any(c in word for c in "%\\&"):
        return None
    line = max((m.start() for m in HARD.finditer(before)), default=0)
    return None if CODED.search(before, line) else start


class Run:
    """A long base64 run of its own, kept compressed."""

    def __init__(self):
        self.parts, self.size, self.tail, self.edges, self.kinds = [], 0, "", False, set()

    def add(self, text: str) -> None:
        self.parts.append(zlib.compress(text.encode(), 1))
        self.size += len(text)
        self.edges = self.edges or EDGE.search(text) is not None
        near = self.tail + text
        if 2 not in self.kinds and HEX.search(near):
            self.kinds.add(2)
        if 1 not in self.kinds and "AKIA" in near and ACCESS.search(near):
            self.kinds.add(1)
        self.tail = near[-32:]

    def texts(self) -> Iterator[str]:
        return (zlib.decompress(x).decode() for x in self.parts)

    def data(self) -> Iterator[bytes]:
        left = ""
        for text in self.texts():
            left += text
            n = len(left) // 4 * 4
            yield bytes_of(left[:n])
            left = left[n:]
        yield bytes_of(left)

    def found(self) -> set[int]:
        """The kinds in the run and in what it opens to, as a whole or in parts."""
        whole = flood(self.data) if self.size % 4 != 1 else None
        if whole is not None:
            return self.kinds | whole.kinds
        if self.edges:
            for _, _, text in opened_parts("".join(self.texts())):
                self.kinds |= text.kinds if isinstance(text, Flood) else {k for _, k, _ in find(text)[1]}
        return self.kinds

    def stand_in(self) -> str:
        """What can take the run's place: a value, or the end of a name, that opens to nothing."""
        return "Z" * 12 + self.tail[-8:]


def kinds_in(pieces: Iterator[bytes]) -> Flood | None:
    """The kinds in the text of a stream, or None if it is no text."""
    kinds: set[int] = set()
    decoder, total, controls = codecs.getincrementaldecoder("utf-8")(), 0, 0
    held, size, due = [], 0, PIECE  # text since the last cut, its length, and the length to look at it again
    run, after = None, ""  # an open run and what follows it

    def look(text: str) -> None:
        if text[:1] and HARD.match(text):
            text = text.strip(text[0])
        if text and len(kinds) < len(KINDS):
            kinds.update(k for _, k, _ in find(text)[1])

    def closed() -> str:
        lone = after[:1] == "=" or after.lstrip("\x20\t\r")[:1] not in ("\n", "%", "\\", "&")
        if lone:
            kinds.update(run.found())
        return (run.stand_in() if lone else "".join(run.texts())) + after

    for piece in pieces:
        text = decoder.decode(piece)
        total += len(text)
        controls += control_count(text)
        if len(kinds) == len(KINDS):
            continue
        if run is not None:
            if not after and (m := RUN.match(text)) is not None:
                run.add(m[0])
                text = text[m.end() :]
            after += text
            if not after.strip("\x20\t\r"):
                continue
            text, run, after = closed(), None, ""
        held.append(text if size else text.lstrip(" "))
        size += len(held[-1])
        if size < due:
            continue
        window = "".join(held)
        if "   " in window and CODED.search(window) is None:  # so nothing counts them
            window = SPACES.sub("  ", window)
        if cut := safe_cut(window) or line_cut(window):
            look(window[:cut])
            window = window[cut:].lstrip(" ")
        if not cut and len(window) >= WHOLE and (start := lone_run(window)) is not None:
            run = Run()
            run.add(window[start:])
            window = window[:start]
        held, size = [window], len(window)
        due = max(PIECE, 2 * size)
    decoder.decode(b"", final=True)
    if run is not None:
        held.append(closed())
    look("".join(held))
    return Flood(kinds) if 0 < total >= 4 * controls else None


def bytes_of(token: str) -> bytes | None:
    body = token.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def opened(token: str) -> str | Flood | None:
    """The text in a base64 token, through any compressed layers in between."""
    data = bytes_of(token)
    return None if data is None else plain(data)


def valid_until(body: str, start: int) -> int:
    """Where base64 from ``start`` on stops being UTF-8, at most four characters too late."""
    decoder, at, step = codecs.getincrementaldecoder("utf-8")(), start, 64
    while at < len(body):
        chunk = body[at : at + step]
        data = bytes_of(chunk if len(chunk) % 4 != 1 else chunk[:-1]) or b""
        before = len(decoder.getstate()[0])
        try:
            decoder.decode(data)
        except UnicodeDecodeError as e:
            return min(len(body), at + max(0, e.start - before) * 4 // 3 + 4)
        at, step = at + step, 2 * step
    return len(body)


def opened_parts(token: str) -> Iterator[tuple[int, int, str | Flood]]:
    """Texts in a base64 token and where they are: the whole, else parts between ``/``, ``-`` and ``_``."""
    if (text := opened(token)) is not None:
        yield 0, len(token), text
        return
    body = token.rstrip("=")
    edges = [m.start() for m in re.finditer("[/_-]", body)]
    done = 0
    for start in [0, *(e + 1 for e in edges)]:
        if start < done or len(body) - start < LEAST:
            continue
        head = bytes_of(body[start : start + LEAST]) or b""
        if compressed(head):
            data = bytes_of(body[start:]) or bytes_of(body[start:-1]) or b""
            if (found := unpacked(data)) is not None and (text := plain(data[: found[1]])) is not None:
                done = min(len(body), start + -(-found[1] * 4 // 3))
                yield start, len(token) if done == len(body) else done, text
                continue
        if valid_until(body[start : start + LEAST], 0) < LEAST or 4 * len(CONTROLS.findall(head.decode("utf-8", "ignore"))) > len(head):
            continue
        limit = valid_until(body, start)
        ends = [len(body)] if limit >= len(body) else []
        k = bisect_right(edges, limit)
        while True:
            for end in ends:
                if end - start >= LEAST and (start or end < len(body)) and (text := opened(body[start:end])) is not None:
                    yield start, len(token) if end == len(body) else end, text
                    done = end
            k -= 1
            if done > start or k < 0 or edges[k] - start < LEAST:
                break
            ends = [edges[k]]


def may_open(head: bytes) -> bool:
    """Whether compressed data or UTF-8 can begin like this."""
    if compressed(head):
        return True
    try:
        codecs.utf_8_decode(head, "strict", False)
    except UnicodeDecodeError:
        return False
    return True


def characters(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes lie inside a character of UTF-8 (not at its start), the places of those that are in
    none, and before each byte the number of characters less four times that of control characters."""
    n, padded = len(data), np.frombuffer(data + bytes(3), np.uint8)
    kind = np.int32 if n < 1 << 29 else np.int64
    inner, bad, surplus = np.zeros(n + 3, bool), [np.zeros(0, kind)], np.zeros(n + 1, kind)
    for x in range(0, n, PIECE):
        own = padded[x : x + PIECE + 3]
        m = len(own) - 3
        more, a, b = (own & 0xC0) == 0x80, own[:m], own[1 : m + 1]
        one = a < 0x80
        two = (a >= 0xC2) & (a < 0xE0) & more[1 : m + 1]
        three = (a >= 0xE0) & (a < 0xF0) & more[1 : m + 1] & more[2 : m + 2] & ((a != 0xE0) | (b >= 0xA0)) & ((a != 0xED) | (b < 0xA0))
        four = (a >= 0xF0) & (a < 0xF5) & more[1 : m + 1] & more[2 : m + 2] & more[3 : m + 3] & ((a != 0xF0) | (b >= 0x90)) & ((a != 0xF4) | (b < 0x90))
        inner[x + 1 : x + m + 1] |= two | three | four
        inner[x + 2 : x + m + 2] |= three | four
        inner[x + 3 : x + m + 3] |= four
        begin = one | two | three | four
        control = one & ((a < 9) | (a >= 14) & (a < 32) | (a == 127)) | two & (a == 0xC2) & (b < 0xA0)
        bad.append((x + np.flatnonzero(~(begin | inner[x : x + m]))).astype(kind))
        surplus[x + 1 : x + m + 1] = surplus[x] + np.cumsum(begin - 4 * control.astype(kind))
    return inner[:n], np.concatenate(bad), surplus


def lasting(data: bytes, cuts: list[int]) -> list[int]:
    """Those of the cuts up to which compressed data can hold text, by one pass over what it holds."""
    good, fed, state = [], 0, [0, 0]
    decoder = codecs.getincrementaldecoder("utf-8")()

    def text() -> bool:
        return 0 < state[0] >= 4 * state[1] and not decoder.getstate()[0]

    def source() -> Iterator[bytes]:
        nonlocal fed
        for k, cut in enumerate(cuts):
            yield data[cuts[k - 1] if k else 0 : cut]
            if text():
                good.append(cut)
            fed = k + 1

    try:
        for piece in deepest(source()):
            own = decoder.decode(piece)
            state[0] += len(own)
            state[1] += len(piece) - len(piece.translate(None, ASCII_CONTROLS)) if piece.isascii() else len(CONTROLS.findall(own))
        if text():  # all that the data holds: the rest follows it
            good.append(cuts[-1])
    except UnicodeDecodeError:
        pass
    except zlib.error:  # the data itself ends here, or what it holds is text that only begins like compressed data
        machine, at = zlib.decompressobj(47), 0
        try:
            for k, cut in enumerate(cuts):
                left = data[at:cut]
                while left and not machine.eof:
                    machine.decompress(left, PIECE)
                    left = machine.unconsumed_tail
                at = cut
                if k >= fed:
                    good.append(cut)
        except zlib.error:
            pass
    return good


def longest(data: bytes, cuts: list[int], plainly: int) -> tuple[int, str | Flood] | None:
    """How much of data that begins like compressed data opens, up to the last cut that lets it, and its
    text (one or two characters are none: nothing can be found in them, and ``lasting`` may not see them).
    ``plainly`` is the last cut up to which the data is text as it is, or 0."""

    def tried() -> Iterator[int]:
        yield cuts[-1]
        yield from sorted({*lasting(data, cuts), plainly} - {0, cuts[-1]}, reverse=True)

    for cut in tried():
        if (found := plain(data[:cut])) is not None and (isinstance(found, Flood) or len(found) > 2):
            inner = unpacked(data[:cut])
            return inner[1] if inner else cut, found
    return None


def ranges(body: str, phase: int, firsts: np.ndarray, lasts: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int, str | Flood]]:
    """Ranges of base64 that open, go over an end of a line and lie in no longer one: each begins at one of
    ``firsts``, which are equal to ``phase`` modulo 4 and thus share their bytes, and ends at one of ``lasts``.

    Text ends before the first byte that is not UTF-8; of the ends up to there, the last that leaves enough
    characters for the controls is found by bisection in the maxima from the right.
    """
    data = bytes_of(body[phase : len(body) - ((len(body) - phase) % 4 == 1)]) or b""
    inner, bad, surplus = characters(data)
    cuts = np.unique((lasts[lasts > phase] - phase) * 3 // 4)
    clean = cuts[~np.append(inner, False)[cuts]]
    at = (firsts - phase) // 4 * 3
    stop = np.append(bad, len(data))[np.searchsorted(bad, at)]
    head = np.frombuffer(data, np.uint8)[at[:, None] + np.arange(2)].astype(np.int64) @ [256, 1]
    packed = (head == 0x1F8B) | (head >> 8 == 0x78) & (head % 31 == 0)
    live = packed | ~inner[at] & (stop - at >= LEAST * 3 // 4)
    firsts, at, stop, packed = firsts[live], at[live], stop[live], packed[live]
    if not len(firsts):
        return
    best = np.zeros(len(at), np.int64)  # the last cut up to which text goes
    groups = np.flatnonzero(np.append(True, stop[1:] != stop[:-1]))
    for a, b in zip(groups.tolist(), [*groups[1:].tolist(), len(at)], strict=True):
        lo, hi = np.searchsorted(clean, [at[a], stop[a]], "right").tolist()
        most = np.maximum.accumulate(surplus[clean[lo:hi]][::-1])
        back = np.searchsorted(most, surplus[at[a:b]])
        found = np.flatnonzero(back < hi - lo)
        best[a + found] = clean[hi - 1 - back[found]]
    ends = phase - (-best * 4 // 3)
    least = np.maximum(firsts + LEAST, begins[np.searchsorted(begins, firsts, "right")] + 1)
    plainly = np.where(packed | (ends < least), 0, ends)
    tried, far = np.flatnonzero(packed | (plainly > np.append(0, np.maximum.accumulate(plainly)[:-1]))), 0
    for start, q, cut, end, low, zipped in zip(*(x[tried].tolist() for x in (firsts, at, best, ends, least, packed)), strict=True):
        low, got = max(low, far + 1), None
        if zipped:
            own = cuts[np.searchsorted(cuts, (low - phase - 1) * 3 // 4, "right") :] - q
            if not len(own) or (got := longest(data[q:], own.tolist(), max(cut - q, 0))) is None:
                continue
            end = start - (-got[0] * 4 // 3)
        if end >= low:
            far = end
            yield start, end, got[1] if got else readable(data[q:cut])


def wrapped(text: str) -> Iterator[tuple[int, int, str | Flood]]:
    """Texts in base64 that goes over line ends, and where they are.

    They begin with a line or after ``/``, ``-`` or ``_`` and end with a line or before one of these.  All such
    ranges count, however many lines there are, but of those that share their bytes only the longest.  A last
    character that is too few for a byte is left out.
    """
    for m in WRAPPED.finditer(text):
        runs = RUN.findall(m[0])
        body, begins = "".join(runs), [0, *accumulate(map(len, runs))]
        edges = [e.start() for e in EDGE.finditer(body)]
        end = min(begins[-2], len(body) - LEAST + 1)
        firsts = sorted(x for x in {*begins, *(e + 1 for e in edges)} if x < end)
        if len(firsts) <= FEW:
            firsts = [x for x in firsts if may_open(bytes_of(body[x : x + LEAST]))]
        if not firsts:
            continue
        places = [m.start() + r.start() for r in RUN.finditer(m[0])]
        firsts, lasts = np.array(firsts), np.array(sorted({*begins[1:], *edges}))
        for phase in np.unique(firsts % 4).tolist():
            for start, end, found in ranges(body, phase, firsts[firsts % 4 == phase], lasts, np.array(begins)):
                i, j = bisect_right(begins, start) - 1, bisect_right(begins, end - 1) - 1
                yield places[i] + start - begins[i], m.end() if end == len(body) else places[j] + end - begins[j], found


def inflated(text: str, first: re.Pattern, unit: re.Pattern) -> Iterator[tuple[int, int, str | Flood]]:
    """Texts of compressed data that is spelt in escapes, and where it is."""
    done = 0
    for m in first.finditer(text):
        if m.start() < done:
            continue
        data, ends, at = bytearray(), [], m.start()
        while (u := unit.match(text, at)) is not None:
            data.append(int(u[1], 16) if u[1] else ord(u[2]) if u[2] else ord(NAMED[u[3]]))
            at = u.end()
            ends.append(at)
        for raw in dict.fromkeys((bytes(data), bytes(data).replace(b"+", b" ") if first is PERCENT_DATA[0] else bytes(data))):
            if (found := unpacked(raw)) is not None and (inner := plain(raw[: found[1]])) is not None:
                done = ends[found[1] - 1]
                yield m.start(), done, inner
                break


def unwrap(layer: Layer) -> Iterator[Layer | tuple[Flood, int, int]]:
    """The layers inside a layer, and texts too long to be one with their place in the original."""

    def token(start: int, end: int, text: str | Flood) -> Layer | tuple[Flood, int, int]:
        a, b = layer.back(start, end)
        return (text, a, b) if isinstance(text, Flood) else Layer(text, [0], [a], [b], [False])

    percent, escapes = "%" in layer.text, "\\" in layer.text
    if layer.steps >= STEPS:
        if (percent or escapes or "&#" in layer.text) and (new := settled(layer)):
            yield new
    else:
        if percent and (new := in_place(layer, PERCENT, unpercent)):
            yield new
        if (escapes or "&#" in layer.text) and (new := in_place(layer, ESCAPES, unescape)):
            yield new
    for there, patterns in ((percent, PERCENT_DATA), (escapes, ESCAPED_DATA)):
        if there:
            for found in inflated(layer.text, *patterns):
                yield token(*found)
    lines: deque[tuple[int, int, str | Flood]] = deque()
    if "\n" in layer.text:
        for start, end, text in wrapped(layer.text):
            lines.append((start, end, text))
            yield token(start, end, text)
    for m in BASE64.finditer(layer.text):
        while lines and lines[0][1] <= m.start():
            lines.popleft()
        for a, b, text in opened_parts(m[0]):
            start, end = m.start() + a, m.start() + b
            if not any(x <= start and end <= y and (isinstance(whole, Flood) or isinstance(text, str) and text in whole) for x, y, whole in lines):
                yield token(start, end, text)


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans with those of decoded layers, each by start, kind and end."""
    if not text:
        return [], []
    base = scan(text)
    work, seen, more = [whole_layer(text)], {hashlib.sha1(text.encode("utf-8", "replace")).digest()}, set(base)
    while work:
        for layer in unwrap(work.pop()):
            if isinstance(layer, tuple):
                more.update((layer[1], kind, layer[2]) for kind in layer[0].kinds)
                continue
            # the same text at two places is two layers: the way back is part of what was seen
            key = hashlib.sha1(repr(layer.back(0, len(layer.text))).encode() + layer.text.encode("utf-8", "replace")).digest()
            if key in seen or not layer.text:
                continue
            seen.add(key)
            for start, kind, end in scan(layer.text):
                a, b = layer.back(start, end)
                more.add((a, kind, b))
            work.append(layer)
    return base, sorted(more)


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``spans`` (replacing a column of that name): kind, start, end in code points, base."""
    rest = docs.drop("spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
        for batch in batches:
            rows = []
            for value in batch.column(text).to_pylist():
                base, every = find(value)
                own = set(base)
                rows.append([{"kind": KINDS[k], "start": a, "end": b, "base": (a, k, b) in own} for a, k, b in every])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(struct))], names=[*batch.schema.names, "spans"])

    return C.map_arrow(rest, run, T.StructType([*rest.schema.fields, T.StructField("spans", SPANS)]))


def masked(text: str | None) -> str | None:
    """The text with each run of overlapping spans replaced by a mark that no pattern matches."""
    every = find(text)[1]
    if not every:
        return text
    parts, at, k = [], 0, 0
    while k < len(every):
        start, kind, end = every[k]
        while k + 1 < len(every) and every[k + 1][0] < end:
            k += 1
            end = max(end, every[k][2])
        parts += [text[at:start], f"<{KINDS[kind]}>"]
        at, k = end, k + 1
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """``docs`` with secrets masked in place; a ``chars`` column follows the new length."""
    place = docs.columns.index(text)
    count = docs.columns.index(chars) if chars in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(text).to_pylist()
            new = [masked(x) for x in old]
            changed = [k for k, (a, b) in enumerate(zip(old, new, strict=True)) if a is not b and a != b]
            if changed:
                batch = batch.set_column(place, batch.schema.field(place), pa.array(new, batch.schema.field(place).type))
                if count is not None:
                    sizes = batch.column(count).to_pylist()
                    for k in changed:
                        sizes[k] = len(new[k])
                    batch = batch.set_column(count, batch.schema.field(count), pa.array(sizes, batch.schema.field(count).type))
            yield batch

    return C.map_arrow(docs, run, docs.schema)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
