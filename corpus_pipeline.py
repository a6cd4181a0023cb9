"""The corpus pipeline: five stages, each one of the corpus operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All stages but the
last return the columns of documents. Quality filtering drops what the
classifier rejects; exact dedup keeps the row that stays of each group of equal
texts; the near-duplicate join keeps one row of each component; PII
sanitisation rewrites texts; packing returns the pieces of the sequences.

In every stage rows of one id are documents of their own, and so are rows
without an id; null and empty texts are documents without words; an empty table
gives an empty table; further columns, of any names, are kept as they are up to
the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalode.llm import exact_dedup, jaccard_join, packing, pii, quality_crf
from stratalode.llm.common import Scratch, given_ids, kept_rows, own_rows, table


def _kept(docs: DataFrame, name: str, choose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of docs whose id choose gives, filtered where they are read."""
    scratch = Scratch(docs.sparkSession, f"pipeline-{name}")
    rows, names = own_rows(docs, scratch)
    if names is not None or not docs.inputFiles():
        rows = scratch.write(rows, "rows")
    ids = scratch.write(choose(rows).select("doc_id"), "kept")
    return given_ids(kept_rows(rows, ids, scratch), names, "doc_id").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (operator 4) accepts.

    A document without words is scored as one empty line. Rows of a repeated
    id have its label where that is learned from; each is judged for itself.
    """
    return quality_crf.accepted(docs, quality_crf.train(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (operator 10): the longest, then the one of smallest id. Documents without words are one group."""
    return _kept(docs, "exact", lambda rows: exact_dedup.exact_dedup(rows).where("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates (operator 9): the one of smallest id. Documents without words are all kept."""
    return _kept(docs, "near", lambda rows: jaccard_join.jaccard_join(rows).where("doc_id = component_id"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and what reveals it replaced (operator 7); null texts stay null."""
    clean = pii.sanitise(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in token sequences (operator 5); a document without a text is its end id alone."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("pii", private), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is a Parquet table in the shared folder, until the next one's is written."""
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs


#: A fitted classifier and a tokenizer can't be told in SQL; tests/llm hold the
#: stages against brute-force versions instead.
ORACLE_SQL = None
