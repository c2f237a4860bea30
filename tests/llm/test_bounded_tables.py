"""Blocks with more distinct words or grams than the hash tables have slots."""

import random

import numpy as np
import pyarrow as pa

from gridloom.llm import common as C
from gridloom.llm import langid, packing, pieces
from gridloom.llm import queries as Q

WORDS = " ".join(f"w{i}x" for i in range(500))


def test_language_id_of_a_text_with_more_grams_than_slots(monkeypatch):
    rng = random.Random(3)
    text = bytes(rng.randrange(32, 127) for _ in range(4000))
    gram, n = np.unique(langid.grams(np.frombuffer(b"the cat sat on the mat", np.uint8), np.array([0, 22]))[0], return_counts=True)
    trees = langid.ContextTrees(["aa", "bb"], np.arange(len(gram)) % 2, gram, n.astype(float))
    monkeypatch.setattr(langid, "TABLE_BITS", 6)
    buf, offs = np.frombuffer(b"ab" + text + b"the cat", np.uint8), np.array([0, 2, 4002, 4009])
    want = np.add.reduceat(trees.code_lengths(langid.grams(buf, offs)[0]), offs[:-1], axis=0)
    scorer = langid.Scorer(trees)
    for _ in range(2):
        assert np.allclose(scorer.lengths(buf, offs), want, rtol=1e-5)


def test_tokens_of_a_text_with_more_words_than_slots(monkeypatch):
    monkeypatch.setattr(packing, "MEMO_BITS", 4)
    monkeypatch.setattr(pieces, "MEMO_BITS", 4)
    texts = ["a b", WORDS, "", None, "w1x a"]
    tokenizer = packing.Tokenizer(open(f"{Q.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb").read())
    for t, got in zip(texts, tokenizer.encode_column(pa.array(texts)), strict=True):
        assert tokenizer.coder.encode_ordinary(t or "") == got.tolist()
    machine = pieces.PieceTransducer(pieces.model_bytes(f"{Q.TOKENIZERS}/piece_bpe_32k.model"))
    ((ids, at, same),) = machine.encode_column(pa.array(texts))
    assert same.all()
    for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
        assert ids[a:b].tolist() == (machine.shortest_path((pieces.MARK + t).replace(" ", pieces.MARK))[0] if t else [])


def test_a_full_table_raises():
    memo = C.WordMemo(3)
    try:
        memo.add(np.arange(1, 9, dtype=np.uint64), [np.zeros(0, np.int32)] * 8)
    except ValueError:
        return
    raise AssertionError("eight words in eight slots leave none free")
