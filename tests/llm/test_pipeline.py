"""The pipeline against brute force over its own stages' rules, and each stage on odd tables."""

import re

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF
from gridloom.llm import quality, secrets
from gridloom.llm.common import materialise, table
from test_llm import LONG, MODEL, ODD, brute_groups, brute_posteriors

STAGES = dict(corpus_pipeline.STAGES)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def contaminated(text, items):
    own, windows = words(text), {}
    for item in items:
        w = words(item)
        size = min(10, len(w))
        if size:
            windows.setdefault(size, set()).update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    return any(tuple(own[i : i + k]) in known for k, known in windows.items() for i in range(len(own) - k + 1))


def holds_base_secret(text):
    assign = re.compile(r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    return any(len(m[1]) >= 12 for m in assign.finditer(text)) or any(len(m[0]) >= 18 for m in re.finditer("AKIA[A-Z0-9]+", text)) or any(len(m[0]) >= 16 for m in re.finditer("[0-9a-f]+", text))


def test_pipeline(spark):
    docs, seen = table(spark, SF, "documents"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        docs = materialise(stage(spark, docs, SF))
        after = {r["doc_id"]: r for r in docs.collect()}
        assert len(after) == docs.count() and set(after) <= {r["doc_id"] for r in before}
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        seen[name] = (before, after)

    before, after = seen["quality"]
    scored = quality.classify(table(spark, SF, "documents"), table(spark, SF, "labels"), F.col("source"), F.col("lang"))
    p = {r["doc_id"]: r["doc_score"] for r in scored.collect()}
    want = brute_posteriors([(r["source"], r["lang"], p[r["doc_id"]]) for r in before])
    assert set(after) == {r["doc_id"] for r, (_, _, score) in zip(before, want, strict=True) if score >= 0.5}
    labels = {r["doc_id"]: r["quality"] == 1 and r["toxic"] == 0 for r in table(spark, SF, "labels").collect()}
    good = [r["doc_id"] for r in before if labels.get(r["doc_id"])]
    assert sum(i in after for i in good) >= 0.95 * len(good)
    assert sum(i in after for i, g in labels.items() if not g) <= 0.15 * sum(not g for g in labels.values())

    before, after = seen["near_duplicates"]
    groups = brute_groups([r["text"] for r in before], [r["doc_id"] for r in before])
    assert set(after) == {c for _, _, c in groups}

    before, after = seen["decontamination"]
    items = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    assert set(after) == {r["doc_id"] for r in before if not contaminated(r["text"], items)} and len(after) < len(before)

    before, after = seen["secrets"]
    assert len(before) == len(after)
    changed = 0
    for r in before:
        new, spans = after[r["doc_id"]], secrets.find(r["text"])[1]
        assert len(new["text"]) == new["n_chars"] and not holds_base_secret(new["text"])
        covered = {i for a, _, b in spans for i in range(a, b)}
        kept = "".join(c for i, c in enumerate(r["text"]) if i not in covered)
        assert re.sub("<(?:assign|access|hex)>", "", new["text"]) == kept or "<" in kept  # all else stays
        changed += new["text"] != r["text"]
        assert (new["text"] != r["text"]) == bool(spans)
    assert changed >= sum(holds_base_secret(r["text"]) for r in before) > 0

    before, after = seen["pieces"]
    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert len(before) == len(after) and all(r["lossless"] for r in after.values())
    for r in before:
        assert own.decode(after[r["doc_id"]]["ids"]) == r["text"].replace("▁", " ")
    assert {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, SF).collect()} == {k: r["ids"] for k, r in after.items()}


ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, p string, z int, c string, key string, gid int, spans string, n_hit string, ids string, in_0 string"


@pytest.fixture(scope="module")
def odd(spark):
    good = [f"the river stone number {i} lay under a tree of red and blue leaves by the old house" for i in range(3)]
    texts = [*ODD, LONG, *good, good[0], "password=abcdefghijklmnop", None]
    rows = [(None if i % 5 == 4 else i, t, None if i % 3 else "en", None if i % 4 else "s", None if i % 2 else len(t or ""), 0.5, "own", None, "own", "own", 3, None, "own", "own", "own") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-2], rows[-2], rows[-3]], ODD_SCHEMA).repartition(3).cache()


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_on_an_odd_table(spark, odd, name):
    out = STAGES[name](spark, odd, SF)
    rows, before = out.collect(), odd.collect()
    if name == "pieces":  # ids are replaced, the text is gone
        assert set(odd.columns) - set(out.columns) == {"text"} and len(set(out.columns)) == len(out.columns)
    else:
        assert out.columns == odd.columns
    if name in ("quality", "near_duplicates", "decontamination"):
        left = [tuple(r) for r in before]
        for r in rows:
            left.remove(tuple(r))  # rows stay as they are
    if name == "near_duplicates":
        assert len(rows) == len(before) - 4 and sum(r["text"] is None for r in rows) == 2
    if name == "decontamination":
        assert len(rows) == len(before)
    if name == "secrets":
        assert len(rows) == len(before) and sum(r["text"] == "<assign>" for r in rows) == 3
        assert all(r["n_chars"] == 8 for r in rows if r["text"] == "<assign>") and sorted((r["text"] or "" for r in rows if r["text"] != "<assign>")) == sorted(r["text"] or "" for r in before if r["text"] != "password=abcdefghijklmnop")
    if name == "pieces":
        assert len(rows) == len(before) and all(r["lossless"] for r in rows)


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_on_an_empty_table(spark, odd, name):
    assert STAGES[name](spark, odd.limit(0), SF).count() == 0
