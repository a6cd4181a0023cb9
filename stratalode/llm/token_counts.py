"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch of texts are one ragged NumPy array of byte symbols. In
each round every sequence applies its own lowest-rank pair at all its places,
all sequences at once; the symbols that are left when no sequence has a ranked
pair are the tokens. What was found for a pre-token is kept per worker, up to
a bound, so that a frequent one is merged once.

Null and empty texts have 0 tokens and bytes. Rows that repeat count each.
Special strings inside texts are one token each, as by the library's default.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import lean, vocabulary_path


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, limit: int = 1024, vocabulary: str | None = None
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row; n_tokens > limit is over.

    vocabulary: path of a byte-level BPE file on the executors; None is the
    public 50k one. Only the two named columns are read; others are ignored.
    """

    def run(batches):
        path = vocabulary or vocabulary_path()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = [n for _, part in bpe.chunks(texts) for n in bpe.count(part, path, "merge").tolist()]
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts])],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    one = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return one.mapInArrow(lean(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark, sf_dir):
    from .common import table

    return token_counts(table(spark, sf_dir, "documents"))
