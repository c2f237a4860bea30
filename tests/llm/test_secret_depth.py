"""Deep nesting, floods of inflated data and cycles: linear time, bounded memory, whole results."""

import base64
import gzip
import random
import resource
import time
import zlib

import pytest

from gridloom.llm import secrets

SECRET = "password=correcthorsebattery"


def timed(text):
    began = time.perf_counter()
    found = secrets.find(text)[1]
    assert time.perf_counter() - began < 20
    return found


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 5, 50, 100_000])
def test_nested_escapes(depth):
    for text in (f"née %{'25' * depth}70assword=correcthorsebattery ok", f"née \\u005c{'u005c' * depth}x70assword=correcthorsebattery ok", f"née &#38;{'#38;' * depth}#112;assword=correcthorsebattery ok"):
        end = text.index(" ok")
        assert [x for x in timed(text) if x[1] == 0] == [(4, 0, end)], depth  # 2525... is itself a hex span


def test_mixed_nesting():
    text = SECRET
    rng = random.Random(1)
    for _ in range(6):  # each layer codes some characters of the one before
        text = "".join(rng.choice([f"%{ord(c):02X}", f"\\u{ord(c):04x}", f"\\x{ord(c):02x}", f"&#{ord(c)};"]) if rng.random() < 0.3 else c for c in text)
    assert (2, 0, 2 + len(text)) in timed(f"a {text} z")


def test_settled_equals_one_by_one(monkeypatch):
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice(["%41", "%C3%A9", "\\u00e9", "\\ud83d\\ude00", "\\ude00", "&#233;", "é", "%", "\\", "x", "%25", "\\x41", "&#x41;", "&#", "😀"]) for _ in range(rng.randrange(12)))
        layer, one = secrets.whole_layer(text), secrets.settled(secrets.whole_layer(text))
        for _ in range(60):
            step = secrets.in_place(layer, secrets.PERCENT, secrets.unpercent) or secrets.in_place(layer, secrets.ESCAPES, secrets.unescape)
            if step is None:
                break
            layer = step
        assert (one.text if one else text) == layer.text or "�" in layer.text + (one.text if one else ""), text
        if one and one.text == layer.text:
            for a in range(len(one.text)):
                assert one.back(a, a + 1)[0] <= one.back(a, a + 1)[1] <= len(text)


@pytest.mark.parametrize("fill", [b"\0", b" ", b"A", b"word and word "])
def test_flood_in_bounded_memory(fill):
    """Up to 1 GB that inflates out of a few MB of text; text with a secret at the far end, and zeros."""
    size, machine = 1 << (30 if len(fill) == 1 else 27), zlib.compressobj(1, wbits=31)
    chunk = fill * ((1 << 20) // len(fill))
    packed = b"".join([*(machine.compress(chunk) for _ in range(size // len(chunk))), machine.compress(f" {SECRET} ".encode()), machine.flush()])
    token = base64.b64encode(packed).decode()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    began = time.perf_counter()
    found = [x for x in secrets.find(f"x {token} y")[1] if x[1] == 0]
    assert time.perf_counter() - began < 90
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000
    assert found == ([] if fill == b"\0" else [(2, 0, 2 + len(token))])


def test_flood_inside_flood():
    rng = random.Random(2)
    inner = gzip.compress(b" ".join(bytes(rng.choices(b"abcdefghij", k=5)) for _ in range(2_000_000)) + f" {SECRET} x".encode(), 1, mtime=0)
    assert len(inner) > secrets.WHOLE
    token = base64.b64encode(gzip.compress(inner, mtime=0)).decode()
    assert timed(f"x {token} y") == [(2, 0, 2 + len(token))]


def test_cycles_end():
    data = b"plain text that goes round"
    for _ in range(300):
        data = gzip.compress(data, 1, mtime=0)
    assert timed(f"x {base64.b64encode(data).decode()} y") == [x for x in secrets.scan(f"x {base64.b64encode(data).decode()} y")]
