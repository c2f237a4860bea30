"""Token ids packed into fixed rows: best-fit decreasing with a segment tree over capacities.

Each scan partition tokenises its documents (a byte-level BPE vocabulary, one end token after each
document), splits documents longer than a row into full rows plus a rest, and packs the segments of
at most ``window_tokens`` at a time.  Best fit asks the segment tree for the smallest remaining
capacity that still holds a segment, so a segment costs O(log row length).  Nothing is shuffled and
a task that is run again writes the same rows; rows of one window are the only ones it can mix.

One output row is one row of the id matrix: ``ids`` (little-endian, padded to ``row_tokens``), its
``cu_seqlens`` (0, then the end of each segment), ``resets`` (where positions start again), and for
each segment the document and the token of it that the segment begins with.  A null or empty text is
one end token; repeated rows are packed as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridloom.llm import common as C

#: The vocabulary's pre-token pattern, as its tokenizer publishes it (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WINDOW_TOKENS = 1 << 22
MEMO_BITS = 20
RESULT = T.StructType(
    [
        T.StructField("pack_id", T.LongType()),
        T.StructField("n_tokens", T.IntegerType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("cu_seqlens", T.ArrayType(T.IntegerType(), False)),
        T.StructField("resets", T.ArrayType(T.IntegerType(), False)),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("doc_starts", T.ArrayType(T.LongType(), False)),
    ]
)


class CapacityTree:
    """Open rows by remaining capacity; a segment tree finds the smallest capacity that is enough."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(self.leaves)]

    def put(self, row: int, left: int) -> None:
        self.rows[left].append(row)
        if len(self.rows[left]) == 1:
            self._mark(left, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """A row with the smallest remaining capacity of at least ``need``, and that capacity."""
        node = need + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        left = node - self.leaves
        row = self.rows[left].pop()
        if not self.rows[left]:
            self._mark(left, -1)
        return row, left

    def _mark(self, left: int, by: int) -> None:
        node = left + self.leaves
        while node:
            self.count[node] += by
            node >>= 1


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Rows of segment numbers; ``sizes`` are between 1 and ``capacity``, ties in input order."""
    tree, rows = CapacityTree(capacity), []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        found = tree.take(sizes[k])
        if found is None:
            row, left = len(rows), capacity
            rows.append([])
        else:
            row, left = found
        rows[row].append(k)
        tree.put(row, left - sizes[k])
    return rows


class Tokenizer:
    """Byte-level BPE of a tiktoken vocabulary, with a table of words that were encoded before.

    The pattern never joins a space and the word after it to what stands before, so texts whose words
    are parted by single spaces are encoded word by word; any other text is encoded as a whole.
    """

    def __init__(self, ranks: bytes):
        import tiktoken

        own = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own, special_tokens={})
        self.end = len(own)
        self.dtype = np.dtype("<u2") if self.end < 1 << 16 else np.dtype("<u4")
        self.memo = C.WordMemo(MEMO_BITS, self.dtype)
        self.spelling = C.Spelling([word for word, _ in sorted(own.items(), key=lambda x: x[1])])

    def solve(self, words: list[str], first: np.ndarray) -> list[np.ndarray]:
        encode = self.coder.encode_ordinary
        return [np.array(encode(w if lead else f" {w}"), self.dtype) for w, lead in zip(words, first.tolist(), strict=True)]

    def encode_column(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each row.  They are spelled and compared with the text, so words whose hashes
        agree in the table can't swap ids: such a row is encoded as a whole."""
        for start, end, buf, offs, _ in C.blocks(column):
            odd = C.uneven_spaces(buf, offs) | spaced_breaks(buf, offs)
            ids, at = C.tokens_of(buf, offs, self.memo, self.solve, True)
            out, where = self.spelling.spell(ids)
            where = where[at]
            odd |= ~C.same_rows(out, where[:-1], where[1:], buf, offs)
            for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                yield np.array(self.coder.encode_ordinary(buf[offs[k] : offs[k + 1]].tobytes().decode()), self.dtype) if odd[k] else ids[a:b]

    def decode(self, ids) -> str:
        return self.coder.decode_bytes([int(x) for x in ids]).decode("utf-8", "replace")


def spaced_breaks(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which rows hold white space other than a space next to a space, or such of several bytes at all."""
    space = buf == 0x20
    other = (buf >= 0x09) & (buf <= 0x0D) | (buf >= 0x1C) & (buf <= 0x1F)
    at = [np.flatnonzero(space[1:] & other[:-1] | other[1:] & space[:-1]) + 1]
    for lead in (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80"):
        found = np.flatnonzero(buf == lead[0])
        for k, b in enumerate(lead[1:], 1):
            found = found[found + k < len(buf)]
            found = found[buf[found + k] == b]
        if lead == b"\xe2\x80":
            found = found[found + 2 < len(buf)]
            last = buf[found + 2]
            found = found[(last <= 0x8A) | (last == 0xA8) | (last == 0xA9) | (last == 0xAF)]
        at.append(found)
    return C.rows_with(buf, offs, np.concatenate(at))


def packed(rows: list[tuple[int | None, np.ndarray]], tokenizer: Tokenizer, capacity: int) -> Iterator[dict]:
    """The matrix rows of some documents' ids."""
    who, part, starts = [], [], []
    for doc_id, ids in rows:
        for at in range(0, len(ids), capacity):
            who.append(doc_id)
            part.append(ids[at : at + capacity])
            starts.append(at)
    for row in best_fit_decreasing([len(x) for x in part], capacity):
        size = [len(part[k]) for k in row]
        ends = np.cumsum(size)
        pad = np.full(capacity - int(ends[-1]), tokenizer.end, tokenizer.dtype)
        yield {
            "n_tokens": int(ends[-1]),
            "ids": np.concatenate([*(part[k] for k in row), pad]).tobytes(),
            "cu_seqlens": [0, *ends.tolist()],
            "resets": [0, *ends[:-1].tolist()],
            "doc_ids": [who[k] for k in row],
            "doc_starts": [starts[k] for k in row],
        }


def pack_documents(docs: DataFrame, vocabulary: str, row_tokens: int = 2048, window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """The packed id matrix of ``docs`` (``doc_id``, ``text``); other columns are not read."""
    with open(vocabulary, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError("the vocabulary is larger than 64 MB")
    shared, key = docs.sparkSession.sparkContext.broadcast(data), uuid.uuid4().hex
    schema = pa.schema([("pack_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = C.held(key, lambda: Tokenizer(shared.value))
        number = TaskContext.get().partitionId() << 40
        held: list[tuple[int | None, np.ndarray]] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, total
            out = []
            for row in packed(held, tokenizer, row_tokens):
                out.append(row | {"pack_id": number})
                number += 1
                if len(out) == 512:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
            held.clear()
            total = 0

        end = np.array([tokenizer.end], tokenizer.dtype)
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tokenizer.encode_column(batch.column("text")), strict=True):
                held.append((doc_id, np.concatenate((ids, end))))
                total += len(ids) + 1
                if total >= window_tokens:
                    yield from flush()
        yield from flush()

    return C.map_arrow(docs.select("doc_id", "text"), run, RESULT)


def write_packed(rows: DataFrame, path: str) -> None:
    """Write the matrix as Parquet: one binary row of ids each, with lengths and resets beside it."""
    rows.write.parquet(path)


def unpack(rows, tokenizer: Tokenizer) -> dict[int | None, list[str]]:
    """Texts by document from collected rows: the inverse of ``pack_documents``, for checks."""
    parts: dict = {}
    for row in rows:
        ids = np.frombuffer(bytes(row["ids"]), tokenizer.dtype)
        for k, (doc_id, start) in enumerate(zip(row["doc_ids"], row["doc_starts"], strict=True)):
            parts.setdefault(doc_id, []).append((start, ids[row["cu_seqlens"][k] : row["cu_seqlens"][k + 1]]))
    texts: dict = {}
    for doc_id, own in parts.items():
        flat = np.concatenate([x for _, x in sorted(own, key=lambda p: p[0])]).tolist()
        texts[doc_id] = []
        while flat:
            end = flat.index(tokenizer.end)
            texts[doc_id].append(tokenizer.decode(flat[:end]))
            flat = flat[end + 1 :]
    return texts
