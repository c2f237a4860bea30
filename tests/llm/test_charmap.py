"""The compiled normaliser and models without bytes, against the published library."""

import random

import pyarrow as pa
import pytest
import sentencepiece

from gridloom.llm import charmap, pieces
from test_llm import MODEL


def varint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def field(number, value):
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def rule_blob(name):
    spec = dict(pieces.fields(sentencepiece.SentencePieceNormalizer(rule_name=name).serialized_model_proto()))[3]
    return dict(pieces.fields(spec)).get(2, b"")


def with_map(name, trim):
    """The model with another character map and with extra spaces taken out or not."""
    return open(MODEL, "rb").read() + field(3, field(2, rule_blob(name)) + field(3, 1) + field(4, trim) + field(5, 1))


CHARS = list("abc AÄäöß½ﬁﬀ㍿ｶﾞＡ１．\t\n\u200b\u00a0\u3000\u0308\u0301é日本한국어각ᄀ\u1161ª²①…“”") + ["a\u0308", "e\u0301", "  ", "\u0041\u030a"]


@pytest.mark.parametrize("name", ["nfkc", "nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf"])
def test_character_maps(name):
    own, theirs = charmap.CharacterMap(rule_blob(name)), sentencepiece.SentencePieceNormalizer(rule_name=name, add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
    assert len(own.rules) > 1000
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice(CHARS) for _ in range(rng.randrange(12)))
        assert own(text) == theirs.normalize(text), repr(text)
    for source, result in rng.sample(sorted(own.rules.items()), 2000):
        assert own(source) == result


@pytest.mark.parametrize("trim", [0, 1])
def test_a_model_with_a_map(trim):
    data = with_map("nmt_nfkc", trim)
    machine, theirs = pieces.PieceTransducer(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    rng = random.Random(2)
    texts = ["".join(rng.choice(CHARS + ["the ", "ing "]) for _ in range(rng.randrange(20))) for _ in range(400)]
    for ids, at, same in machine.encode_column(pa.array(texts)):
        assert same.all()
    got = [ids[a:b].tolist() for ids, at, _ in machine.encode_column(pa.array(texts)) for a, b in zip(at[:-1], at[1:])]
    for text, own in zip(texts, got, strict=True):
        normal = theirs.normalize(text).replace(pieces.MARK, " ")
        assert " " * bool(machine.normalise(text)) + machine.normalise(text) == normal, repr(text)
        assert own == machine.encode(text).tolist() and machine.decode(own) == machine.normalise(text)


def test_a_model_without_bytes():
    data = open(MODEL, "rb").read() + field(2, field(35, 0))
    kept = b"".join(field(n, v) for n, v in pieces.fields(data) if not (n == 1 and dict(pieces.fields(v)).get(3) == pieces.BYTE))
    machine = pieces.PieceTransducer(kept)
    assert machine.decode(machine.encode("the house")) == "the house"
    ids = machine.encode("a 𐍈𐍈𐍈 b").tolist()
    assert ids.count(machine.unk) == 1 and machine.decode(ids).split() == ["a", "\u2047", "b"]
    ((ids, at, same),) = machine.encode_column(pa.array(["the house", "x 𐍈"]))
    assert same.tolist() == [True, False]
