"""Mixing sources to target weights.

Words are summed by source; the sources' targets share the whole by weight,
stop at a multiple of what a source has, and hand what is above to the others.
A source's rate is its target by its size. Each document is emitted floor(rate)
times, and once more if a draw seeded by its hash falls below the fraction.

Draws hang on the document alone, so reruns, other partitions and lost
executors give the same mix. Sizes are summed before they are shuffled; the
rates go to the documents by a broadcast if they are few, else by a join that
Spark splits where a source is large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, few, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
_LOCAL = 33  # bits of a row's place in its partition in monotonically_increasing_id


def words(text: Column) -> Column:
    """Number of words; 0 of null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(id_: Column, text: Column, seed: str) -> Column:
    """A number of [0, 1) that hangs on the row's id and text."""
    told = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(id_.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(told, 1, 12), 16, 10).cast("double") / float(1 << 48)


def weighted(sources: DataFrame, weights: tuple[int, ...], scratch: Scratch) -> DataFrame:
    """sources (source, source_size) with ``weight``: weights in turn, by code point, null last.

    Places are a sorted table's, numbered by partition; only each partition's
    count meets the driver.
    """
    placed = scratch.write(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", _LOCAL)
    counts = sorted(tuple(r) for r in placed.groupBy(part.alias("part")).count().collect())
    begins, at = [], 0
    for k, n in counts:
        begins.append((k, at))
        at += n
    begins = placed.sparkSession.createDataFrame(begins, "part long, begin long")
    place = F.col("begin") + F.col("at").bitwiseAND((1 << _LOCAL) - 1)
    turn = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (place % len(weights)).cast("int") + 1)
    return placed.join(F.broadcast(begins), part == F.col("part")).select("source", "source_size", turn.alias("weight"))  # a row a partition


def _stopped(most: int, p: int, q: int) -> Column:
    """Whether a source's share p / q * weight is above the most that it may give."""
    number = lambda x: F.lit(x).cast("decimal(19,0)")
    return (F.col("source_size") * most).cast("decimal(18,0)") * number(q) <= F.col("weight").cast("decimal(18,0)") * number(p)


def level(rows: DataFrame, most: int) -> tuple[int, int]:
    """(p, q): the share of one unit of weight, p / q words, once none is above ``most`` times its size.

    Each round fixes the sources that are above and shares the rest anew; it is
    one aggregate, two numbers of which meet the driver.
    """
    total, q = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    p, total = total or 0, total or 0
    while q and total:
        over = _stopped(most, p, q)
        fixed, left = rows.agg(F.sum(F.when(over, F.col("source_size") * most).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        if (total - fixed, left) == (p, q):
            return p, q
        p, q = total - fixed, left
    return 0, 1


def source_rates(docs: DataFrame, *, text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """(source, source_size, target, rate) of each source; null is a source, the last one.

    Targets add up to the words of all sources. A source without words has
    target and rate 0.
    """
    scratch = scratch or Scratch(docs.sparkSession, "source-mix")
    sizes = docs.select(F.col(source_col).cast("string").alias("source"), words(F.col(text_col).cast("string")).alias("size"))
    rows = scratch.write(weighted(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, scratch), "weighted")
    p, q = level(rows, most)
    target = F.when(_stopped(most, p, q), (F.col("source_size") * most).cast("double")).otherwise((F.col("weight") * F.lit(p).cast("long")).cast("double") / F.lit(q).cast("double"))
    rated = rows.select("source", "source_size", target.alias("target"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return scratch.write(rated.withColumn("rate", rate), "rates")


COPIES = "__copies"


def copies(docs: DataFrame, rates: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """docs with ``COPIES``, how many times the mix takes each row, and ``__source_size`` and ``__target`` of its source."""
    own = few(rates.select(F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("rate").alias("__rate")))
    rows = docs.join(own, F.col(source_col).cast("string").eqNullSafe(F.col("__source")))
    whole = F.floor("__rate")
    more = draw(F.col(id_col), F.col(text_col).cast("string"), seed) < F.col("__rate") - whole
    return rows.select(*docs.columns, (whole + more.cast("long")).alias(COPIES), "__source_size", "__target")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: str = "mix", scratch: Scratch | None = None) -> DataFrame:
    """The mix: rows of docs, each as many times as its source's rate and its draw say, with docs' columns, of any names.

    Null texts have no words, a null source is a source of its own. Rows of one
    id, and those without an id, are drawn each by its text; rows alike in both
    share a draw. No row is emitted more than ``most`` times; an empty table
    gives an empty mix.
    """
    rates = source_rates(docs, text_col=text_col, source_col=source_col, weights=weights, most=most, scratch=scratch)
    taken = copies(docs, rates, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed)
    times = F.filter(F.sequence(F.lit(0).cast("long"), F.col(COPIES)), lambda x: x > 0)
    return taken.select(*docs.columns, F.explode(times).alias(COPIES)).drop(COPIES)


def op13_source_mix(spark, sf_dir):
    """How often :func:`mix` emits each document, as words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    size = words(F.col("text"))
    rows = copies(docs, source_rates(docs))
    return rows.select("doc_id", size.alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (size * F.col(COPIES)).alias("taken"))
