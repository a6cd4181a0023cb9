"""BPE encoding and decoding by dynamic programming over prefixes.

For each prefix of a pre-token the last token of its encoding is unique. An
automaton over the vocabulary gives the tokens that end at a place; one of them
is the last token of the prefix if a pair test says that it may follow the last
token of the prefix before it. Following the stored tokens back from the end
emits the exact ids (:class:`stratalode.llm.bpe.PrefixEncoder`).

Null and empty texts give no ids. Special strings in a text are one id each.
Decoding joins the tokens' bytes; bytes that are no UTF-8 become U+FFFD.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import lean, table, vocabulary_path


def _encoded(texts: list[str], path: str):
    for _, part in bpe.chunks(texts):
        ids, n = bpe.encode(part, path, "prefix")
        stop = np.cumsum(n)
        for s, e in zip((stop - n).tolist(), stop.tolist(), strict=True):
            yield ids[s:e]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of each row."""

    def run(batches):
        path = vocabulary or vocabulary_path()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = pa.array([x.astype(np.int32) for x in _encoded(texts, path)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    one = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return one.mapInArrow(lean(run), "doc_id long, ids array<int>")


def decode(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", *, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""

    def run(batches):
        v = bpe.load(vocabulary or vocabulary_path())
        for batch in batches:
            texts = [v.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(
        lean(run), "doc_id long, text string"
    )


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of the text decoded from them."""

    def run(batches):
        path = vocabulary or vocabulary_path()
        v = bpe.load(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n, ids_sha, text_sha = [], [], []
            for ids in _encoded(texts, path):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(v.decode(ids.tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    one = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return one.mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe_codec(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"))
