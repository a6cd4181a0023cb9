"""Interaction of filters: what each of five filters removes in every order of them.

A document is a mask of the filters that it fails. Documents are counted by part
and mask, all of them, the good and the toxic ones, so that a part is 32 counts
whatever its size. The subset-zeta transform turns these into the survivors of
every subset of filters, one pass over the counts for each filter. A step of an
order is the difference between two neighbouring subsets, and so are its labels.

Only digests, masks and ids are shuffled, and they are counted before that: of
a text that a third of all rows share each task sends one row for each id.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
REPEATED = 1 << FILTERS.index("E")
EVERY = (1 << len(FILTERS)) - 1
COUNTS = ("n", "good", "toxic")
STEPS = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def failed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, mask, digest) of each row: the filters A to D that its text fails, as bits."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    rows = rows.select("doc_id", "part", "text", words.alias("words"))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    fails = (n < 50, 100 * distinct.cast("long") < 65 * n.cast("long"), 100 * capitals.cast("long") > 5 * F.length("text").cast("long"), F.col("text").rlike("[#$%&*|]"))
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", mask.cast("int").alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))


def mask_counts(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and the filters that they fail."""
    scratch = scratch or Scratch(docs.sparkSession, "filter-audit")
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # Rows without an id meet no label; they are spread by their digests.
    rows = failed(docs, id_col, text_col, part_col).withColumn("spread", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0)))
    rows = rows.join(marks.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left")
    rows = rows.select("doc_id", "digest", "part", "mask", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    rows = scratch.write(rows.groupBy("doc_id", "digest", "part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n")), "rows")

    sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")]
    total = rows.groupBy("part", "mask").agg(*sums)
    # Of one text the rows of its smallest id, a null one last, repeat nothing.
    of_id = rows.groupBy("digest", "mask", "doc_id").agg(F.collect_list(F.struct("part", "n", "good", "toxic")).alias("rows"))
    firsts = of_id.groupBy("digest", "mask").agg(F.min_by("rows", F.struct(F.col("doc_id").isNull(), "doc_id")).alias("rows"))
    firsts = firsts.select("mask", F.inline("rows")).groupBy("part", "mask").agg(*sums)
    repeated = total.unionByName(firsts.select("part", "mask", *[(-F.col(c)).alias(c) for c in COUNTS])).withColumn("mask", F.col("mask") + REPEATED)
    return firsts.unionByName(repeated).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in COUNTS])


def survivors(counts: np.ndarray) -> np.ndarray:
    """[..., S]: the sum of [..., mask] over the masks that share no filter with S: subset-zeta transform, then complements."""
    f = counts.copy()
    masks = np.arange(EVERY + 1)
    for k in range(len(FILTERS)):
        has = masks[masks >> k & 1 == 1]
        f[..., has] += f[..., has ^ (1 << k)]
    return f[..., masks ^ EVERY]


def _orders() -> tuple[list[str], np.ndarray, np.ndarray]:
    """(orders, filter of each step, filters before each step), as orders by steps."""
    orders = list(permutations(range(len(FILTERS))))
    filters = np.array(orders)
    return ["".join(FILTERS[k] for k in o) for o in orders], filters, np.cumsum(1 << filters, axis=1) - (1 << filters)


def _steps(batches):
    """A part's counts to its rows, whole batches of parts at a time."""
    names, filters, before = _orders()
    after, masks = before | (1 << filters), np.arange(EVERY + 1)
    size = np.array([m.bit_count() for m in masks])
    for batch in batches:
        parts = batch.num_rows
        shape = (len(COUNTS), EVERY + 1, parts)
        left = survivors(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]).reshape(shape).transpose(0, 2, 1))
        lost = left[:, :, before] - left[:, :, after]  # counts, parts, orders, steps
        fails = np.stack([left[0][:, 0] - left[0][:, 1 << k] for k in range(len(FILTERS))], 1)
        alone = np.stack([left[0][:, EVERY ^ (1 << k)] - left[0][:, EVERY] for k in range(len(FILTERS))], 1)
        shapley = np.zeros((parts, len(FILTERS)), np.int64)
        for k in range(len(FILTERS)):
            without = masks[masks >> k & 1 == 0]
            orders = np.array([factorial(s) * factorial(len(FILTERS) - 1 - s) for s in size[without]])
            shapley[:, k] = ((left[0][:, without] - left[0][:, without | (1 << k)]) * orders).sum(1)
        columns = [left[0][:, after], lost[0], fails[:, filters] - lost[0], alone[:, filters], lost[1], lost[2], shapley[:, filters]]
        each = filters.size
        at = pa.array(np.repeat(np.arange(parts), each))
        order = pa.array(names).take(pa.array(np.tile(np.repeat(np.arange(len(names)), len(FILTERS)), parts)))
        step = pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), parts * len(names)))
        arrays = [batch.column(0).take(at), order, step, *[pa.array(c.reshape(-1)) for c in columns]]
        yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in STEPS.split(", ")])


def filter_audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", scratch: Scratch | None = None) -> DataFrame:
    """STEPS: a row for each part, each of the 120 orders of the filters and each of its steps.

    Null texts are empty, a null part is the empty one, so is what they join.
    Repeats are told by SHA-256 of whole texts; of rows of one text those of its
    smallest id fail nothing by it, and a null id is the largest. Rows of one id
    are documents each. A document is good (toxic) if any label of its id says
    so; without labels, or without an id, it is neither. Other columns of docs
    and labels, of any names, are ignored; without documents there are no parts.
    """
    counts = mask_counts(docs, labels, scratch, id_col=id_col, text_col=text_col, part_col=part_col)
    cells = [F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)).alias(f"{c}{m}") for c in COUNTS for m in range(EVERY + 1)]
    return counts.groupBy("part").agg(*cells).mapInArrow(_steps, STEPS)


def op12_filter_audit(spark, sf_dir):
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
