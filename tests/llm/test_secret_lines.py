"""Base64 across line ends against brute force: any number of lines, any widths, neighbours on all sides."""

import base64
import codecs
import gzip
import random
import time
import zlib

import pytest

import corpus_pipeline
from conftest import SF
from gridloom.llm import secrets

SECRET = "password=correcthorsebattery"
PROSE = " ".join(random.Random(3).choice(["red", "blue", "tree", "stone", "river", "a", "of"]) for _ in range(120))


def b64(data):
    return base64.b64encode(data.encode() if isinstance(data, str) else data).decode()


def cut(token, rng, widths):
    out = []
    while token:
        k = rng.choice(widths)
        out.append(token[:k])
        token = token[k:]
    return out


def assigned(text):
    return {(a, b) for a, k, b in secrets.find(text)[1] if k == 0}


def every_range(text):
    """All ranges of base64 over line ends that open, but only the longest of those that share their bytes."""
    found = set()
    for m in secrets.WRAPPED.finditer(text):
        places, body, begins = [], "", []
        for r in secrets.RUN.finditer(m[0]):
            begins.append(len(body))
            places += range(m.start() + r.start(), m.start() + r.end())
            body += r[0]
        edges = [k for k, c in enumerate(body) if c in "/_-"]
        own = []
        for a in {*begins, *(k + 1 for k in edges)}:
            for b in {*begins[1:], len(body), *edges}:
                if b - a < secrets.LEAST:
                    continue
                data = secrets.bytes_of(body[a:b])
                if data is None:  # one character too many
                    data = secrets.bytes_of(body[a : b - 1])
                if (inner := secrets.plain(data)) is None or len(inner) < 3:
                    continue
                taken = secrets.unpacked(data)
                end = a - (-(taken[1] if taken else len(data)) * 4 // 3)
                if end - a >= secrets.LEAST and any(a < k < end for k in begins):
                    own.append((a, end, inner))
        for a, b, inner in own:
            if not any((x, y) != (a, b) and x <= a and b <= y and (a - x) % 4 == 0 for x, y, _ in own):
                found.add((places[a], m.end() if b == len(body) else places[b - 1] + 1, inner))
    return found


@pytest.mark.parametrize("pack", [str.encode, lambda x: gzip.compress(x.encode(), mtime=0), lambda x: zlib.compress(x.encode())])
@pytest.mark.parametrize("n", [2, 5, 11, 14, 30, 200])
def test_lines_of_odd_widths_between_others(pack, n):
    """However many words on lines stand before and after it, and whatever their widths are."""
    rng = random.Random(n)
    for widths in ([8, 12, 20], [5, 6, 7, 9], [76, 60, 4], [40, 41, 42]):
        token = "\n".join(cut(b64(pack(f"{PROSE[:90]} {SECRET} {PROSE}")).rstrip("="), rng, widths))
        around = lambda: "\n".join("".join(rng.choices("bcdfgklmnprst", k=rng.choice([3, 7, 9, 20]))) for _ in range(n))
        text = f"{around()}\n{token}\n{around()}"
        first = text.index(token)
        assert any(a <= first and first + len(token) <= b < len(text) for a, b in assigned(text)), (widths, text)


def test_many_blocks_in_one_list():
    rng, tokens = random.Random(9), []
    for k in range(40):
        data = f"{'x' * (k % 3)} {SECRET}{k:04} is all that there is"
        tokens.append("\n".join(cut(b64(data if k % 2 else gzip.compress(data.encode(), mtime=0)).rstrip("="), rng, [11, 18, 23])))
    text = "\n\n".join("\n".join(["kzzk", "kzzkzzkz", t, "zkkzkkzk"]) for t in tokens).replace("\n\n", "\n")
    spans = assigned(text)
    for t in tokens:
        first = text.index(t)
        assert any(a <= first and first + len(t) <= b for a, b in spans), t


@pytest.mark.parametrize("few", [0, 64])
@pytest.mark.parametrize("seed", range(8))
def test_every_range(seed, few, monkeypatch):
    monkeypatch.setattr(secrets, "FEW", few)
    rng = random.Random(seed)
    hits = 0
    for _ in range(60):
        lines = []
        for _ in range(rng.randrange(1, 9)):
            kind = rng.randrange(7)
            text = " ".join(rng.choice(["né", "a", "stone", "\x01\x02", "\x85", "x^2", "😀", "tree"]) for _ in range(rng.randrange(1, 16)))
            data = text.encode()
            if kind == 1:
                data = gzip.compress(data, mtime=0)
            elif kind == 2:
                data = zlib.compress(data, 0)[: rng.randrange(3, 40)]
            elif kind == 3:
                data = gzip.compress(data + bytes(rng.choices(range(256), k=4)) + data, 0, mtime=0)
            elif kind == 4:
                data = bytes(rng.choices([0, 1, 65, 66, 195, 169], k=rng.randrange(30)))
            elif kind == 5:
                data = gzip.compress(gzip.compress(data, mtime=0) + gzip.compress(b"more", mtime=0), mtime=0)
            token = b64(data).rstrip("=" if rng.random() < 0.8 else "")
            if rng.random() < 0.3:
                token = rng.choice(["a/", "key-", "_"]) + token + rng.choice(["", "/b", "-c/d"])
            lines += cut(token, rng, [3, 4, 7, 16, 30]) + rng.choice([[], ["word"], ["", ""], ["-----END"]])
        text = "\n".join(lines)
        want = every_range(text)
        got = {(a, b, t) for a, b, t in secrets.wrapped(text)}
        hits += len(want)
        assert got == want, text
    assert hits > 20


@pytest.mark.parametrize("piece", [1, 2, 5, 1 << 20])
def test_characters(piece, monkeypatch):
    monkeypatch.setattr(secrets, "PIECE", piece)
    rng = random.Random(4)
    for _ in range(300):
        data = b"".join(rng.choice(["a", "é", "€", "😀", "\x01", "\x85", "퟿", ""]).encode() if rng.random() < 0.7 else rng.choice([b"\xed\xa0\x80", b"\xc0\xaf", b"\xf4\x90\x80\x80", b"\xe0\x80\x80", b"\xf0\x9f", b"\xc3", b"\x80", b"\xff"]) for _ in range(rng.randrange(9)))
        inner, bad, surplus = secrets.characters(data)
        for a in range(len(data)):
            for b in range(a + 1, len(data) + 1):
                try:
                    text = codecs.utf_8_decode(data[a:b], "strict", True)[0]
                except UnicodeDecodeError:
                    text = None
                whole = not inner[a] and not any(a <= k < b for k in bad) and (b == len(data) or not inner[b])
                assert whole == (text is not None), (data, a, b)
                if whole:
                    assert surplus[b] - surplus[a] == len(text) - 4 * len(secrets.CONTROLS.findall(text))


@pytest.mark.parametrize(
    "text",
    ["AAAAAAAAAAAAAAAAAAAA\n" * 50_000, "AAAA\n" * 50_000, "a/b-\n" * 50_000, "QUJD\n" * 50_000, "AQEBQUFB\nQUFB\n" * 20_000, "eF4y\n" * 50_000, "a\n" * 1_000_000, "\n".join(f"{k:x}" for k in range(50_000)), "\n".join(f"{k * 2654435761 % (1 << 64):016x}" for k in range(20_000))],
    ids=["zeros", "short", "edges", "text", "mixed", "zlib", "letters", "counts", "hashes"],
)
def test_long_lists_end(text):
    began = time.perf_counter()
    assert not assigned(text)
    assert time.perf_counter() - began < 20


def test_binary_data_over_many_lines_ends():
    token = b64(gzip.compress(f"{PROSE} {SECRET} ".encode() + random.Random(1).randbytes(1_000_000), mtime=0))
    text = "\n".join(token[k : k + 76] for k in range(0, len(token), 76))
    began = time.perf_counter()
    secrets.find(text)
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("n", [14, 60])
def test_pipeline_masks_lines_of_odd_widths(spark, n):
    """The stage leaves nothing of a secret that stands in base64 among many other lines."""
    rng, texts, tokens = random.Random(n), [], []
    for pack in (str.encode, lambda x: gzip.compress(x.encode(), mtime=0), lambda x: zlib.compress(x.encode())):
        own = cut(b64(pack(f"{PROSE[:90]} {SECRET} {PROSE}")).rstrip("="), rng, [8, 12, 20, 41])
        around = ["".join(rng.choices("bcdfgklmnprst", k=rng.choice([3, 7, 9]))) for _ in range(2 * n)]
        tokens.append("\n".join(own))
        texts.append("\n".join(["A list of words:", *around[:n], *own, *around[n:], "That is all."]))
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    rows = {r["doc_id"]: r for r in corpus_pipeline.secret_masking(spark, docs, SF).collect()}
    for i, (text, token) in enumerate(zip(texts, tokens, strict=True)):
        new = rows[i]["text"]
        first = text.index(token)
        assert "<assign>" in new and token.split("\n")[0] not in new and rows[i]["n_chars"] == len(new), new
        assert new.startswith(text[: first - 60]) and new.endswith("That is all.")
