"""What the corpus operators share: tables, shared scratch tables, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BYTE_BPE = "byte_bpe_50k.json"


def vocabulary_path(name: str = BYTE_BPE) -> str:
    """Place of a public vocabulary file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset one of our own, in local mode only: no other machine reads it."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="stratalode-")
        context.setCheckpointDir(folder)
    return folder


class Scratch:
    """Tables in the shared folder that cut lineage; drop() what is no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.kept: list[str] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "snappy").parquet(path)  # others' buffers grow the executors outside their heap
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, context = self.spark._jvm, self.spark.sparkContext
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def few(df: DataFrame, rows: int = 200_000, size: int = 20_000_000) -> DataFrame:
    """df marked for broadcast if it has at most so many rows and, as text, characters; else as it is, for a join that shuffles."""
    n, long = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(F.length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(df) if n <= rows and (long or 0) <= size else df


def lean(run: Callable, rows: int = 1024) -> Callable:
    """A function over Arrow batches for mapInArrow, given at most ``rows`` rows at a time; at its end freed memory goes back to the system.

    Long texts make batches of Spark's default 10,000 rows large, in the
    executor's JVM outside its heap too, so the session's batches are held to
    ``rows`` where they would be larger. Workers are used again by other tasks,
    and what a task has freed would else count against the executor as long as
    the worker lives.
    """
    session, key = SparkSession.getActiveSession(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    if session is not None and not 0 < int(session.conf.get(key)) <= rows:
        session.conf.set(key, str(rows))

    def held(batches):
        try:
            yield from run(batch.slice(at, rows) for batch in batches for at in range(0, max(1, batch.num_rows), rows))
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library isn't glibc
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return held


ROW = "__row"


def own_rows(rows: DataFrame, scratch: Scratch, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame | None]:
    """(rows under ids of their own, (``ROW``, given id) of each row).

    Where no id repeats and none is null these are the rows as they are, and
    None. Else the rows are written in the order of their ids, null last, and
    numbered in that order, so that a smaller number is never a larger id.
    """
    if not rows.groupBy(id_col).count().where((F.col("count") > 1) | F.col(id_col).isNull()).limit(1).count():
        return rows, None
    others = [c for c, kind in rows.dtypes if c != id_col and "map<" not in kind and kind != "variant"]  # those that have an order
    ordered = rows.orderBy(F.col(id_col).asc_nulls_last(), *others).withColumn(ROW, F.monotonically_increasing_id())
    written = scratch.write(ordered, "own-rows")
    return written.withColumn(id_col, F.col(ROW)).drop(ROW), written.select(ROW, id_col)


def given_ids(result: DataFrame, names: DataFrame | None, *columns: str) -> DataFrame:
    """result with the ids that rows were given in place of their numbers, in each of the columns."""
    if names is None:
        return result
    order = result.columns
    for c in columns:
        result = result.join(names.select(F.col(ROW).alias(c), F.col(names.columns[1]).alias("__given")), c).withColumn(c, F.col("__given")).drop("__given")
    return result.select(*order)


def kept_rows(rows: DataFrame, ids: DataFrame, scratch: Scratch, id_col: str = "doc_id", *, most_words: int = 1_000_000) -> DataFrame:
    """The rows whose id is in ids (id_col); rows are read from Parquet files, their ids their own.

    Ids are joined with the places of their rows, file and number, so that only
    ids are shuffled. What stays is one bit a row, 64 to a word, and the rows
    are filtered where they are read, by a broadcast of their files' words.
    most_words: words (some 60 bytes each) of one broadcast, so that 64,000,000
    rows are one; more files are read in turns, each with its own words.
    """
    file, at = F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index")
    places = rows.select(id_col, file.alias("__file"), at.alias("__at")).join(ids.select(id_col), id_col, "left_semi")
    words = places.groupBy("__file", F.shiftright("__at", 6).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(__at % 64 as int))")).alias("__bits"))
    words = scratch.write(words, "kept-bits")
    turns = max(1, -(-words.count() // most_words))

    def chosen(part: DataFrame, own: DataFrame) -> DataFrame:
        placed = part.select("*", file.alias("__file"), F.shiftright(at, 6).alias("__word"), (at % 64).cast("int").alias("__bit"))
        return placed.join(F.broadcast(own), ["__file", "__word"]).where("shiftright(__bits, __bit) & 1 = 1").select(*rows.columns)

    if turns == 1:
        return chosen(rows, words)
    files: dict[int, list[str]] = {}
    for path, turn in rows.select(F.col("_metadata.file_path").alias("p")).distinct().select("p", F.pmod(F.xxhash64("p"), F.lit(turns))).collect():  # one a file
        files.setdefault(turn, []).append(path)
    parts = [chosen(scratch.spark.read.schema(rows.schema).parquet(*paths), words.where(F.pmod("__file", F.lit(turns)) == turn)) for turn, paths in sorted(files.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def components(scratch: Scratch, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): rows (node, component), component the smallest node.

    Alternates two steps until no label falls: every node takes the smallest
    label among its neighbours, then labels are replaced by the labels of their
    labels, which halves the height of the label trees. Minima are combined
    before they are shuffled; the join that gives a hub's edges its label is
    one that Spark splits where it is skewed. Only nodes with an edge are
    returned. Each round's labels are a written table.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    both = scratch.write(both, "edges")
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels-0")
    for k in range(1, most_rounds + 1):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        # A label that falls pulls the node it named along: its tree hooks onto the smaller one.
        lower = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        hooks = lower.where("component < was").groupBy(F.col("was").alias("node")).agg(F.min("component").alias("hook"))
        hooked = lower.join(hooks, "node", "left").select("node", "was", F.least("component", F.coalesce("hook", "component")).alias("component"))
        hooked = scratch.write(hooked, f"hooked-{k}")
        up = hooked.select(F.col("node").alias("component"), F.col("component").alias("up"))
        jumped = hooked.join(up, "component", "left").select("node", "was", F.least("component", F.coalesce("up", "component")).alias("component"))
        jumped = scratch.write(jumped, f"labels-{k}")
        scratch.drop(f"hooked-{k}", f"labels-{k - 1}")
        labels = jumped.select("node", "component")
        if not jumped.where("component < was").limit(1).count():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
