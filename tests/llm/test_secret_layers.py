"""Layers that hold text with odd characters, compressed data in escapes, and base64 across lines and after paths."""

import base64
import gzip
import random
import zlib
from urllib.parse import quote, quote_plus

import pytest

from gridloom.llm import secrets

SECRET = "password=correcthorsebattery"
PROSE = " ".join(random.Random(7).choice(["red", "blue", "tree", "stone", "river", "a", "of"]) for _ in range(200))


def b64(data):
    return base64.b64encode(data.encode() if isinstance(data, str) else data).decode()


def lines(token, width=76, end="\n"):
    return end.join(token[k : k + width] for k in range(0, len(token), width))


def spans(text):
    return {(a, b) for a, k, b in secrets.find(text)[1] if k == 0}


def within(text, part):
    assert (text.index(part), text.index(part) + len(part)) in spans(text), text
    assert secrets.find(secrets.masked(text))[1] == []


@pytest.mark.parametrize("odd", [" ", "　", "​", "﻿", "\f", "\0", "\x1b"])
def test_a_layer_with_an_odd_character_is_text(odd):
    token = b64(f"{odd}some words {SECRET}")
    within(f"see {token} end", token)


def test_binary_is_no_layer():
    assert secrets.opened(b64(bytes(range(32)))) is None and secrets.opened(b64(bytes([0, 159, 146, 150] * 8))) is None


@pytest.mark.parametrize("pack", [lambda x: gzip.compress(x, mtime=0), zlib.compress, lambda x: zlib.compress(x, 1), lambda x: gzip.compress(gzip.compress(x, mtime=0), mtime=0)])
def test_compressed_data_in_escapes(pack):
    data = pack(f"{PROSE} {SECRET}".encode())
    for token in ("".join(f"%{c:02X}" for c in data), quote(data, safe=""), quote_plus(data), "".join(f"\\x{c:02x}" for c in data), "".join(f"\\u{c:04x}" for c in data), repr(data)[2:-1]):
        text = f"q: {token}"
        assert any(a <= 3 and b >= len(text) - 1 for a, b in spans(text)), token
        assert "correct" not in secrets.masked(text)
        assert spans(text + "\nwords after it") == spans(text)


@pytest.mark.parametrize("end", ["\n", "\r\n", "\n    "])
@pytest.mark.parametrize("around", ["{}", "see: {}\nand more", "{}\n\nmore", "word\n{}\nword", "-----BEGIN KEY-----\n{}\n-----END KEY-----"])
@pytest.mark.parametrize("what", ["gzip", "text", "short"])
def test_wrapped_base64(end, around, what):
    data = {"gzip": gzip.compress(f"{PROSE} {SECRET}".encode(), mtime=0), "text": f"{PROSE[:44]} {SECRET} {PROSE}".encode(), "short": f"{PROSE[:44]} {SECRET}".encode()}[what]
    token = lines(b64(data), end=end)
    text = around.format(token)
    first, last = text.index(token), text.index(token) + len(token)
    assert any(a <= first and b >= last for a, b in spans(text)), text
    assert secrets.find(secrets.masked(text))[1] == []


@pytest.mark.parametrize("around", ["https://example.org/a/{}", "/a/{}", "x-{}", "user_{}", "/aaa/bb/c/{}/d/ee", "k-{}-v2", "/a/b_{}_c"])
@pytest.mark.parametrize("pack", [lambda x: x, lambda x: gzip.compress(x, mtime=0)])
def test_base64_after_a_path(around, pack):
    for n in range(3):
        token = b64(pack(f"{'x' * n} {SECRET} is all".encode()))
        text = f"go {around.format(token)} end"
        body = token.rstrip("=")
        first = text.index(token)
        assert any(a == first and b >= first + len(body) for a, b in spans(text)), text


def test_long_runs_end():
    rng = random.Random(2)
    blob = b64(rng.randbytes(300_000))
    for text in (blob, lines(blob), "-" * 200_000, "a/" * 100_000, "word\n" * 50_000, "internationalization\n" * 20_000):
        assert [x for x in secrets.find(text)[1] if x[1] == 0] == []
