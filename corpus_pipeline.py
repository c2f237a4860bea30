"""The corpus pipeline: five stages from ``documents`` to token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``.  All but the last return the columns of ``documents``, and columns of
any other name pass through as well:

1. quality: documents that the hierarchical posterior rejects go (8);
2. near duplicates: one document of each group of linked documents stays (6);
3. decontamination: documents that hold a benchmark window go (7);
4. secrets: spans of secrets, also inside nested encodings, are masked and ``n_chars`` follows (9);
5. pieces: texts become SentencePiece ids, each decoded again as a check (10).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import common, decontam, jaccard, pieces, quality, secrets
from gridloom.llm.common import materialise, table
from gridloom.llm.queries import TOKENIZERS


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the posterior keeps.

    Null and empty texts are judged by their lack of words and their site; a null ``source`` or ``lang``
    is a site of its own; repeated rows are judged alike, so all or none stay; very long texts are
    read block by block; ties (a posterior of exactly 0.5) stay; an empty table stays empty.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group: the smallest ``doc_id``, of equal ids the smallest text hash.

    Rows that are equal in both count as copies and one stays; a null id stays only where its group has
    no other; null texts and texts without words link with nothing and stay; an empty table stays empty.
    """
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows with a hit.  Null, empty and wordless texts have none; repeated rows go or stay together;
    a very long text goes like any other; an empty table or benchmark changes nothing."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), remove="document")


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks spans row by row; no row goes.  Null and empty texts and rows without a finding stay as they
    are, a null ``n_chars`` too; where a text changes, ``n_chars`` is its new length."""
    return secrets.redact(docs)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each text by its ids; no row goes.  Null and empty texts have no ids; repeated rows get the
    same; columns named like the result's are replaced; an empty table stays empty."""
    return pieces.encode_pieces(docs, f"{TOKENIZERS}/piece_bpe_32k.model", drop=("text",))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_masking),
    ("pieces", sentence_pieces),
]
#: SQL can't express the classifier and the piece encoding; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = table(spark, sf_dir, "documents"), common.mark()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
            common.release(mark)  # what the stages before it wrote
    return docs
