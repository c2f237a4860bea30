"""Language identification by prediction by partial matching.

For each language a byte context tree of orders 0 to ``ORDER`` is counted on a bounded sample of
labelled texts and then frozen.  The code length of a byte in a language follows the longest known
context: a symbol seen c times among T in q kinds costs -log2(c / (T + q)), any other symbol pays the
escape -log2(q / (T + q)) and falls to the next shorter context, and in the end to 8 bits.  A text's
code length is the sum over all its bytes; the shortest language wins, ties go to the first name.

The code length of a byte depends on the byte and the ``ORDER`` before it, so each worker keeps a
table of such grams with their exact costs in all languages, fills it by the frozen trees as grams
turn up, and scores whole blocks with array look-ups.

The training sample takes texts by a hash of the text itself, at a rate that holds about
``TRAIN_BYTES`` of distinct texts over all languages.  Only text is read when predicting.  A null text, or one without a
letter, is ``und`` with score 0; so is everything if there was nothing to learn from.  Repeated rows are
predicted alike and copies teach once; a very long text is scored slice by slice; an empty table gives
no rows; columns named like the result's are replaced, others pass through.  One small row for each
distinct language goes to the driver.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import common as C

ORDER = 4
TRAIN_BYTES = 4 << 20
TABLE_BITS = 20
TABLE_BYTES = 64 << 20  # of costs in the table, however many languages there are
ASCII_LETTER = re.compile("[A-Za-z]")
RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
ONE = np.uint64(1)


def has_letter(text: str | None) -> bool:
    return bool(text) and (ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def grams(buf: np.ndarray, offs: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For each byte, it and the ``order`` bytes before it in its text as one number (zero bytes stand
    before a text; A-Z count as a-z), and where each row's begin."""
    n, rows = len(buf), len(offs) - 1
    padded = np.zeros(n + order * rows, np.uint8)
    low = C.LOWER[buf]
    for k, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
        at = a + order * (k + 1)
        padded[at : at + b - a] = low[a:b]
    place = np.arange(n) + np.repeat(np.arange(1, rows + 1) * order, np.diff(offs))
    out = np.zeros(len(padded), np.uint64)
    for j in range(order + 1):
        out[j:] |= padded[: len(padded) - j].astype(np.uint64) << np.uint64(8 * j)
    return out[place], offs


class ContextTrees:
    """The frozen context trees of all languages, as sorted arrays for each order."""

    def __init__(self, names: list[str], lang: np.ndarray, gram: np.ndarray, count: np.ndarray, order: int = ORDER):
        self.names, self.order, n = names, order, len(names)
        self.symbols: list[tuple[np.ndarray, np.ndarray]] = []  # keys of k + 1 bytes; counts by language
        self.contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # keys of k bytes; totals and kinds
        for k in range(order + 1):
            keys, at = np.unique(gram & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
            seen = np.zeros((len(keys), n))
            np.add.at(seen, (at, lang), count)
            above, up = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(above), n)), np.zeros((len(above), n))
            np.add.at(total, up, seen)
            np.add.at(kinds, up, seen > 0)
            self.symbols.append((keys, seen))
            self.contexts.append((above, total, kinds))

    def code_lengths(self, gram: np.ndarray) -> np.ndarray:
        """Bits of each gram's last byte after the bytes before it, by language."""
        cost = np.zeros((len(gram), len(self.names)))
        open_ = np.ones(cost.shape, bool)
        for k in range(self.order, -1, -1):
            own = gram & np.uint64((1 << 8 * (k + 1)) - 1)
            keys, seen = self.symbols[k]
            above, total, kinds = self.contexts[k]
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            c = np.where((keys[at] == own)[:, None], seen[at], 0)
            up = np.minimum(np.searchsorted(above, own >> np.uint64(8)), len(above) - 1)
            there = (above[up] == own >> np.uint64(8))[:, None]
            t, q = np.where(there, total[up], 0), np.where(there, kinds[up], 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                hit, escape = -np.log2(c / (t + q)), -np.log2(q / (t + q))
            found = open_ & (c > 0)
            cost[found] += hit[found]
            open_ &= ~found
            known = open_ & (t > 0)
            cost[known] += escape[known]
        return cost + 8.0 * open_


class Scorer:
    """The trees with a table of the grams that were met before."""

    def __init__(self, trees: ContextTrees):
        self.trees = trees
        bits = min(TABLE_BITS, (TABLE_BYTES // (8 * len(trees.names))).bit_length() - 1)
        self.memo = C.WordMemo(max(4, bits))
        self.costs = np.zeros((1 << self.memo.bits, len(trees.names)))

    def lengths(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Code length in bits of each row in each language."""
        keys, offs = grams(buf, offs, self.trees.order)
        hashed = C.mix(keys) | ONE  # the table needs keys that are not 0
        out = np.zeros((len(offs) - 1, len(self.trees.names)))
        for own in self.memo.slices(len(keys)):
            key, gram = hashed[own], keys[own]
            slots = self.memo.find(key)
            lost = np.flatnonzero(slots < 0)
            if len(lost):
                new, at = np.unique(key[lost], return_index=True)
                if not self.memo.room(len(new)):
                    self.memo.clear()
                    new, at = np.unique(key, return_index=True)
                    lost = np.arange(len(key))
                self.memo.add(new, [np.zeros(0, np.int32)] * len(new))
                self.costs[self.memo.find(new)] = self.trees.code_lengths(gram[lost[at]])
                slots = self.memo.find(key)
            row = np.searchsorted(offs, np.arange(own.start, own.stop), "right") - 1
            cut = np.flatnonzero(np.diff(row, prepend=-1))
            out[row[cut]] += np.add.reduceat(self.costs[slots], cut, axis=0)
        return out


def learn(labelled: DataFrame, order: int = ORDER, train_bytes: int = TRAIN_BYTES) -> ContextTrees | None:
    """Context trees from rows of ``text`` and ``lang``; rows with a null in either are left out."""
    rows = labelled.filter("text is not null and lang is not null and text <> ''").select("text", "lang")
    each = rows.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.max(F.octet_length("text")).alias("bytes"))  # copies count once
    sizes = {r["lang"]: r["bytes"] for r in each.groupBy("lang").agg(F.sum("bytes").alias("bytes")).collect()}
    if not sizes:
        return None
    names = sorted(sizes)
    rate = {k: min(1.0, train_bytes / len(names) / sizes[k]) for k in names}
    limit = F.create_map(*[F.lit(x) for k in names for x in (k, int(rate[k] * (1 << 31)))])
    sample = rows.filter(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 31)) <= limit[F.col("lang")]).dropDuplicates(["text", "lang"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array(batch.column("lang").to_pylist(), dtype=object)
            for name in set(lang.tolist()):
                own = batch.column("text").filter(pa.array(lang == name))
                for _, _, buf, offs, _ in C.blocks(own):
                    keys, n = np.unique(grams(buf, offs, order)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(C.signed(keys)), pa.array(n)], names=["lang", "gram", "n"])

    counted = C.map_arrow(sample, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang = np.searchsorted(np.array(names), np.array(counted.column("lang").to_pylist(), dtype=str)) if counted.num_rows else np.zeros(0, np.int64)
    return ContextTrees(names, lang, np.asarray(counted.column("gram")).view(np.uint64), np.asarray(counted.column("n")).astype(float), order)


def identify(docs: DataFrame, trees: ContextTrees | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (replacing columns of these names).

    The score is the winner's share of 2**-(code length) among the languages, for a text of at most 64
    bytes with this text's mean code lengths: long texts do not all round to 1.
    """
    rest = docs.drop(*RESULT.names)
    if trees is None:
        return rest.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    shared, key = docs.sparkSession.sparkContext.broadcast(trees), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = C.held(key, lambda: Scorer(shared.value))
        for batch in batches:
            texts, langs, scores = batch.column(text).to_pylist(), [], []
            for start, end, buf, offs, _ in C.blocks(batch.column(text)):
                bits, size = scorer.lengths(buf, offs), np.diff(offs)
                best = bits.argmin(axis=1)
                mean = (bits - bits.min(axis=1, keepdims=True)) / np.maximum(size, 1)[:, None] * np.minimum(size, 64)[:, None]
                share = 1.0 / np.exp2(-mean).sum(axis=1)
                for k in range(end - start):
                    value = texts[start + k]
                    known = has_letter(value)
                    langs.append(scorer.trees.names[best[k]] if known else "und")
                    scores.append(float(share[k]) if known else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, *RESULT.names])

    return C.map_arrow(rest, run, T.StructType([*rest.schema.fields, *RESULT.fields]))
