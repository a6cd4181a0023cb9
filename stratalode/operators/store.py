"""Sinks: upserts by unit, batches, serialisation, deletes, on Parquet tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def unit_id(*keys: str):
    """Surrogate id of a unit: a hash of its key, the same in any order of arrival."""
    return F.xxhash64(*keys)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without what new has by key, and new: what a write of ``new`` leaves."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def first_wins(batch: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """One row per key of a batch: the one that came first."""
    rest = [c for c in batch.columns if c not in keys]
    return batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), seq).alias("r")).select(*keys, "r.*")


def last_wins(batches: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """One row per key over batches: the one that came last."""
    rest = [c for c in batches.columns if c not in keys]
    return batches.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(*keys, "r.*")


def store_batches(old: DataFrame, batches: DataFrame, unit: list[str], batch: str = "batch", seq: str = "seq") -> DataFrame:
    """What batches (unit columns, batch, seq, ...) leave of a table: the first batch replaces, units repeat as the first of a batch and the last of batches."""
    once = last_wins(first_wins(batches, [*unit, batch], seq), unit, batch)
    return once.select(*[c for c in old.columns if c in once.columns])


def skip_known(incoming: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """incoming whose content isn't stored yet for its key."""
    return incoming.join(known.select(*keys).distinct(), keys, "left_anti")


def delete_project(table: DataFrame, project: str) -> DataFrame:
    return table.where(~F.col("project").eqNullSafe(F.lit(project)))


def write_partitioned(table: DataFrame, path: str, keys: tuple[str, ...] = ("project", "version")) -> None:
    """Overwrites the partitions that the table has rows of, and no others."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def clear(table: DataFrame, path: str) -> None:
    """Leaves an empty table."""
    table.limit(0).write.mode("overwrite").parquet(path)


def clear_all(spark: SparkSession, root: str, names: tuple[str, ...]) -> None:
    """Leaves every table under a folder, a search index's too, empty."""
    for name in names:
        clear(spark.read.parquet(f"{root}/{name}"), f"{root}/{name}")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for written tables: under spark.checkpoint.dir, or of this machine where that is unset and Spark runs on it alone."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="stratalode-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of that name, in whatever store Spark reads."""
    files, at = _folder(spark, path)
    return files.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, in order; none where there is no folder."""
    files, at = _folder(spark, path)
    return sorted(e.getPath().getName() for e in files.listStatus(at)) if files.exists(at) else []


def numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers n of a folder's entries named prefix + n."""
    return sorted(int(n.removeprefix(prefix)) for n in names(spark, path) if n.startswith(prefix) and n.removeprefix(prefix).isdigit())


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file unless there is one of that name; whether it did."""
    files, at = _folder(spark, path)
    try:
        out = files.create(at, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in str(error.java_exception) or "already exists" in str(error.java_exception):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path).collect())


def remove(spark: SparkSession, *paths: str) -> None:
    """Removes folders of written tables."""
    for path in paths:
        files, at = _folder(spark, path)
        files.delete(at, True)


def snapshot_json(constants: DataFrame) -> DataFrame:
    """(unit_name, json) of (unit_name, source_kind, value, usages array<string>): one document a unit, constants by value."""
    items = F.sort_array(F.collect_list(F.struct("value", "usages")))
    rows = constants.groupBy("unit_name", "source_kind").agg(items.alias("constants"))
    return rows.select("unit_name", F.to_json(F.struct(F.col("unit_name").alias("source"), F.col("source_kind").alias("sourceKind"), "constants")).alias("json"))


def chunk(rows: DataFrame, by: list[str], order: str, size: int = 500) -> DataFrame:
    """rows with ``chunk`` and ``first``: runs of ``size`` within a container, in order.

    The rows are written in the order of container and ``order``, in as many
    parts as Spark makes of them, and numbered in each part; where a container
    goes over several parts, the rows of those before are added. So a container
    of any size is sorted and numbered by many tasks.
    """
    spark, path = rows.sparkSession, work_folder(rows.sparkSession, "chunks")
    placed = rows.orderBy(*by, order).withColumn("_at", F.monotonically_increasing_id())
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path).withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy("_part", *by).agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))  # a row a part and container
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n").withColumnsRenamed({c: f"_of_{c}" for c in ("_part", *by)})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in ("_part", *by)]
    place = F.col("_at") - F.col("_from") + F.col("_before")
    out = placed.join(runs, same).withColumn("chunk", F.floor(place / size)).withColumn("first", F.col("chunk") == 0)
    return out.select(*rows.columns, "chunk", "first")
