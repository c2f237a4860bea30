"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Compilation reads a model file's pieces and normaliser settings and builds the transducer: the
normaliser (the model's character map, see ``charmap``, then its rules for spaces) maps a text to its
escaped form, a trie of pieces is the arc set (weight: the negated score), and a character that no
piece covers takes a byte-fallback arc, or the unknown piece where the model has no bytes.  Encoding
composes the transducer with an input and takes the tropical-semiring shortest path (a forward pass
over the input's states; ties go to the longer last piece).  Where no piece holds a word mark after
another character, which compilation verifies, every path passes the state before each run of marks:
the composition splits there, and the shortest paths of equal words are shared through a bounded
table.  Decoding is the inverse projection: pieces to text, byte pieces to UTF-8, marks to spaces.

Null and empty texts have no pieces; repeated rows get the same; a very long text is a block of its own;
an empty table gives no rows.  The mark U+2581 in a text counts as a space, as the model defines it;
apart from that, decoding gives back the normalised text exactly (``lossless`` is false only where a
model without bytes meets a character that it does not know).
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridloom.llm import common as C
from gridloom.llm.charmap import CharacterMap

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)  # piece types of the file format
MEMO_BITS = 20  # of the table of words whose paths are known
WIDTH, BATCH = 32, 10_000  # characters of a word, and words, that are solved together
UNKNOWN_TEXT = " \u2047 ".encode()  # how the unknown piece is spelt
RESULT = T.StructType([T.StructField("n_pieces", T.IntegerType()), T.StructField("n_bytes", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("lossless", T.BooleanType())])


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class PieceTransducer:
    """The compiled normaliser, pieces and byte fallback of one model."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        self.prefix, self.trim, self.escape, charsmap, fallback = True, True, True, b"", False
        for number, value in fields(model):
            if number == 1:
                own = dict(fields(value))
                self.pieces.append(own[1].decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kinds.append(own.get(3, NORMAL))
            elif number == 2:
                fallback = bool(dict(fields(value)).get(35, 0))
            elif number == 3:
                own = dict(fields(value))
                charsmap = own.get(2, b"")
                self.prefix, self.trim, self.escape = (bool(own.get(k, 1)) for k in (3, 4, 5))
        if not self.escape:
            raise ValueError("the model must escape spaces")
        self.charmap, self.fallback = CharacterMap(charsmap), fallback
        self.unk = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else -1
        if not fallback and self.unk < 0:
            raise ValueError("the model has neither bytes nor an unknown piece")
        normal = [s for s, k in zip(scores, self.kinds, strict=True) if k == NORMAL]
        low, high = min(normal, default=0.0), max(normal, default=0.0)
        self.unknown = 10.0 - low
        self.trie: dict = {}
        self.bytes = [-1] * 256
        for i, (piece, kind) in enumerate(zip(self.pieces, self.kinds, strict=True)):
            if kind == BYTE:
                self.bytes[int(piece[3:5], 16)] = i
            elif kind in (NORMAL, USER_DEFINED):
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"piece {i} has a mark after another character")
                node = self.trie
                for c in piece:
                    node = node.setdefault(c, {})
                node[""] = (i, high * len(piece) * -1 + 0.1 if kind == USER_DEFINED else -scores[i])
        for c in map(chr, range(128)) if fallback else ():  # byte fallback of one byte is an arc like any other
            if "" not in self.trie.setdefault(c, {}):
                self.trie[c][""] = (self.bytes[ord(c)], self.unknown)
        self.out = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else UNKNOWN_TEXT if k == UNKNOWN else p.replace(MARK, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.pairs = {p[i : i + 2] for p, k in zip(self.pieces, self.kinds, strict=True) if k in (NORMAL, USER_DEFINED) for i in range(len(p) - 1)}
        self._tables()
        self.table = C.WordMemo(MEMO_BITS)
        self.spelling = C.Spelling(self.out)

    # ---- normaliser

    def normalise(self, text: str) -> str:
        """The input side of the transducer, before spaces become marks."""
        text = self.charmap(text).replace(MARK, " ")
        if self.trim:
            text = " ".join(x for x in text.split(" ") if x)
        return text

    # ---- encoding

    def shortest_path(self, text: str) -> tuple[list[int], float]:
        """Piece ids and cost of the best path through a marked text."""
        n = len(text)
        best = [0.0] + [float("inf")] * n
        came: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        for i in range(n):
            here, node, one = best[i], self.trie, False
            for j in range(i, n):
                node = node.get(text[j])
                if node is None:
                    break
                end = node.get("")
                if end is not None:
                    one |= j == i
                    if here + end[1] < best[j + 1]:
                        best[j + 1] = here + end[1]
                        came[j + 1] = (i, end[0])
            if not one and here + self.unknown < best[i + 1]:
                best[i + 1] = here + self.unknown
                came[i + 1] = (i, -1)
        ids: list[int] = []
        while n:
            i, piece = came[n]
            if piece >= 0:
                ids.append(piece)
            elif self.fallback:
                ids += [self.bytes[b] for b in reversed(text[i:n].encode("utf-8", "surrogatepass"))]
            elif not ids or ids[-1] != self.unk:  # a run of unknown characters is one piece
                ids.append(self.unk)
            n = i
        return ids[::-1], best[-1]

    def _tables(self) -> None:
        """The trie as arrays: the next state by state and character, for the 127 characters with most arcs."""
        arcs: dict[str, int] = {}
        states: list[dict] = [self.trie]
        for node in states:
            for c, below in node.items():
                if c:
                    arcs[c] = arcs.get(c, 0) + (1 if c != "\n" else len(self.pieces))
                    states.append(below)
        common = sorted(arcs, key=lambda c: (-arcs[c], c))[:127]
        self.char = np.zeros(0x110000, dtype=np.uint8)
        self.char[[ord(c) for c in common]] = np.arange(1, len(common) + 1)
        number = {id(node): i for i, node in enumerate(states)}
        self.next = np.zeros((len(states), 128), dtype=np.int32)
        self.weight = np.full(len(states), np.inf)
        self.piece = np.full(len(states), -1, dtype=np.int32)
        for i, node in enumerate(states):
            for c, below in node.items():
                if not c:
                    self.piece[i], self.weight[i] = below
                elif self.char[ord(c)]:
                    self.next[i, self.char[ord(c)]] = number[id(below)]

    def shortest_paths(self, words: list[str]) -> list[bytes]:
        """``shortest_path`` of many words at once: one forward pass over all their states.

        Words are rows of a character matrix; long ones and those with rarer or uncovered characters
        take the single-input form.
        """
        out: list[bytes] = [b""] * len(words)
        marked = [MARK + w for w in words]
        narrow = [i for i, w in enumerate(marked) if len(w) <= WIDTH]
        width = max((len(marked[i]) for i in narrow), default=1)
        chars = np.array([marked[i] for i in narrow], dtype=f"U{width}").view(np.uint32).reshape(len(narrow), width)
        size = np.array([len(marked[i]) for i in narrow], dtype=np.int64)
        known = self.char[np.minimum(chars, 0x10FFFF)]
        plain = (np.count_nonzero(known, axis=1) == size) if narrow else np.zeros(0, bool)
        plain &= (self.weight[self.next[0, known]].max(axis=1, where=known > 0, initial=0.0) < np.inf) if narrow else plain
        known, size = np.ascontiguousarray(known[plain].T), size[plain]
        own = np.array(narrow, dtype=np.int64)[plain]
        n, width = len(own), int(size.max(initial=0))
        best = np.full((width + 1, n), np.inf)
        best[0] = 0.0
        came, piece = np.zeros((width + 1, n), np.int64), np.full((width + 1, n), -1, np.int32)
        for i in range(width):
            at = np.flatnonzero(size > i)
            node = np.zeros(len(at), np.int32)
            for j in range(i, width):
                node = self.next[node, known[j, at]]
                live = np.flatnonzero(node)
                if not len(live):
                    break
                at, node = at[live], node[live]
                cost = best[i, at] + self.weight[node]
                shorter = np.flatnonzero(cost < best[j + 1, at])
                to = at[shorter]
                best[j + 1, to], came[j + 1, to], piece[j + 1, to] = cost[shorter], i, self.piece[node[shorter]]
        steps, at, rows = [], size.copy(), np.arange(n)
        while (at > 0).any():
            steps.append(np.where(at > 0, piece[at, rows], -1))
            at = np.where(at > 0, came[at, rows], 0)
        ids = np.array(steps[::-1], dtype="<i4").reshape(len(steps), n).T
        kept = ids >= 0
        flat = ids[kept].tobytes()
        ends = np.cumsum(kept.sum(axis=1)) * 4
        for k, a, b in zip(own.tolist(), [0, *ends.tolist()], ends.tolist(), strict=False):
            out[k] = flat[a:b]
        for k in set(range(len(words))) - set(own.tolist()):
            out[k] = np.array(self.shortest_path(marked[k])[0], dtype="<i4").tobytes()
        return out

    def solve(self, words: list[str], _=None) -> list[np.ndarray]:
        """The ids of what follows each run of marks.  No arc spans two characters that are neighbours
        in no piece, so a path passes the state between them: a tail of such characters is cut off."""
        pairs, ends, stems = self.pairs, [], {}
        for w in words:
            end = len(w)
            while self.fallback and end > 1 and w[end - 2 : end] not in pairs:
                end -= 1
            ends.append(end)
            stems[w[:end]] = None
        order = sorted(stems, key=len)
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            stems.update(zip(part, self.shortest_paths(part), strict=True))
        one: dict[str, bytes] = {}
        out = []
        for w, end in zip(words, ends, strict=True):
            got = stems[w[:end]]
            for c in w[end:]:
                if c not in one:
                    one[c] = np.array(self.shortest_path(c)[0], dtype="<i4").tobytes()
                got += one[c]
            out.append(np.frombuffer(got, "<i4"))
        return out

    def encode_column(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each block of a text column: ids, where each row's begin, and whether decoding gave back the text.

        Rows with single spaces only go through the word memo; others are composed as they are, and so
        are rows whose ids don't spell their text (words whose hashes agree in the memo).
        """
        for start, end, buf, offs, _ in C.blocks(column):
            odd = C.uneven_spaces(buf, offs) if self.prefix else np.ones(end - start, bool)
            lead = np.flatnonzero(buf[:-2] == 0xE2) if len(buf) > 2 else np.zeros(0, np.int64)
            odd |= C.rows_with(buf, offs, lead[(buf[lead + 1] == 0x96) & (buf[lead + 2] == 0x81)])
            if self.charmap.rules:
                odd |= np.array([self.charmap.touches(buf[x:y].tobytes().decode()) for x, y in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], bool)
            ids, at = C.tokens_of(buf, offs, self.table, self.solve, False)
            out, where = self.spelling.spell(ids)
            where = where[at]
            odd |= ~C.same_rows(out, where[:-1] + (np.diff(where) > 0), where[1:], buf, offs)  # the prefix is a space
            same = np.ones(end - start, bool)
            if odd.any():
                parts = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                for k in np.flatnonzero(odd).tolist():
                    text = buf[offs[k] : offs[k + 1]].tobytes().decode()
                    parts[k] = self.encode(text)
                    same[k] = self.decode(parts[k]) == self.normalise(text)
                ids = np.concatenate(parts)
                at = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
            yield ids, at, same

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of one text."""
        head, words = self.words(self.normalise(text or ""))
        return np.concatenate([np.frombuffer(head, "<i4"), *self.solve(words)]) if words or head else np.zeros(0, "<i4")

    def words(self, text: str) -> tuple[bytes, list[str]]:
        """What a text's path is cut into: ids before the first mark, then what follows each run of marks."""
        if not text:
            return b"", []
        words, head = text.split(" "), b""
        if not self.prefix:
            head = np.array(self.shortest_path(words[0])[0], dtype="<i4").tobytes()
            words = words[1:]
        if "" in words:  # runs of marks: a path may join them
            joined, run = [], ""
            for w in words:
                if w:
                    joined.append(run + w)
                    run = ""
                else:
                    run += MARK
            words = [*joined, run[1:]] if run else joined
        return head, words

    # ---- decoding

    def decode(self, ids) -> str:
        out = self.out
        text = b"".join([out[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _share(df: DataFrame, path: str):
    """The model file is read once, on the driver; its size is that of a vocabulary."""
    data = model_bytes(path)
    if len(data) > 64 << 20:
        raise ValueError("the model file is larger than 64 MB")
    PieceTransducer(data)
    return df.sparkSession.sparkContext.broadcast(data), uuid.uuid4().hex


def encode_pieces(docs: DataFrame, model: str, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``n_pieces``, ``n_bytes`` (byte-fallback pieces), ``ids`` and ``lossless``.

    ``lossless`` tells whether decoding the ids gave back the normalised text.  Columns of these names
    are replaced; those in ``drop`` are not passed on.
    """
    shared, key = _share(docs, model)
    rest = docs.drop(*RESULT.names)
    passed = [f for f in rest.schema.fields if f.name not in drop]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = C.held(key, lambda: PieceTransducer(shared.value))
        is_byte = np.array([k == BYTE for k in machine.kinds])
        for whole in batches:
            start = 0
            for ids, at, same in machine.encode_column(whole.column(text)):
                batch = whole.slice(start, len(same))
                start += len(same)
                marks = np.concatenate(([0], np.cumsum(is_byte[ids])))
                own = [pa.array(np.diff(at).astype(np.int32)), pa.array(np.diff(marks[at]).astype(np.int32)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32, copy=False))), pa.array(same)]
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in passed), *own], names=[*(f.name for f in passed), *RESULT.names])

    return C.map_arrow(rest, run, T.StructType([*passed, *RESULT.fields]))


def decode_pieces(encoded: DataFrame, model: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``encoded`` with the text of its ids in column ``out``; null ids give a null text."""
    shared, key = _share(encoded, model)
    rest = encoded.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = C.held(key, lambda: PieceTransducer(shared.value))
        for batch in batches:
            texts = [None if x is None else machine.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return C.map_arrow(rest, run, T.StructType([*rest.schema.fields, T.StructField(out, T.StringType())]))
