"""Archive jobs as a stream: state and counters of each job, from its steps.

The counters are Spark's own state, one row a job; each micro-batch gives the
jobs that it changed and no others, and these are a version of the change feed.
So what a batch writes follows the batch, not the number of jobs. The table is
the last change of each job; :meth:`Jobs.compact` folds old versions into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import jobs, store

COUNTERS = "nested_processed long, nested_failed long, nested_total long, status string"
ENDED = ("COMPLETED", "FAILED")


def track(steps: DataFrame, by: list[str]) -> DataFrame:
    """Counters of a batch of steps, or of a stream's (state is one row per job)."""
    return jobs.job_counters(steps, by)


class Jobs:
    """The jobs' change feed under a folder: versions 0, 1, ..., each the rows that a micro-batch changed."""

    def __init__(self, spark: SparkSession, path: str, by: list[str], key_schema: str):
        self.spark, self.path, self.by = spark, path, by
        self.schema = f"{key_schema}, {COUNTERS}, version long"

    def batch(self, changed: DataFrame, number: int) -> None:
        """Writes a version; one that is written again replaces itself."""
        changed.write.mode("overwrite").parquet(f"{self.path}/feed/version={number}")

    def _read(self, name: str) -> DataFrame:
        if not store.exists(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}")

    def _folded(self) -> int:
        """The last version that is folded, -1 if none is."""
        return max((v for v in store.numbers(self.spark, f"{self.path}/base", "upto=") if store.exists(self.spark, f"{self.path}/base/upto={v}/_SUCCESS")), default=-1)

    def changes(self, after: int = -1) -> DataFrame:
        """(keys, counters, status, version) of what changed after a version: what a poll reads, of the feed's new folders only."""
        return self._read("feed").where(F.col("version") > after)

    def ended(self, after: int = -1) -> DataFrame:
        """Jobs that are over by what changed after a version."""
        return self.changes(after).where(F.col("status").isin(*ENDED))

    def table(self) -> DataFrame:
        """(keys, nested_processed, nested_failed, nested_total, status)."""
        upto = self._folded()
        rows = self.changes(upto)
        if upto >= 0:
            rows = rows.unionByName(self._read(f"base/upto={upto}").withColumn("version", F.coalesce("version", F.lit(upto).cast("long"))))
        return jobs.latest_jobs(rows, self.by, "version").drop("version")

    def compact(self, keep: int = 10) -> None:
        """Folds all versions but the last ``keep``, which pollers may still ask for, into one; those folded and older bases go."""
        versions = store.numbers(self.spark, f"{self.path}/feed", "version=")
        upto, before = max((v for v in versions if v <= max(versions) - keep), default=-1), self._folded()
        if upto <= before:
            return
        rows = self.changes(before).where(F.col("version") <= upto)
        if before >= 0:
            rows = rows.unionByName(self._read(f"base/upto={before}").withColumn("version", F.coalesce("version", F.lit(before).cast("long"))))
        jobs.latest_jobs(rows, self.by, "version").select(*[c for c in rows.columns]).write.mode("overwrite").parquet(f"{self.path}/base/upto={upto}")
        store.remove(self.spark, *[f"{self.path}/feed/version={v}" for v in versions if v <= upto])
        store.remove(self.spark, *[f"{self.path}/base/upto={v}" for v in store.numbers(self.spark, f"{self.path}/base", "upto=") if v < upto])


def start(spark: SparkSession, source: str, schema, path: str, checkpoint: str, by: list[str], key_schema: str, kind, most_files: int | None = None) -> StreamingQuery:
    """Tracks jobs from a folder of step files into the feed of :class:`Jobs` under path."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", most_files) if most_files else reader
    counted = track(reader.parquet(source).withColumn("kind", kind), by).select(*by, *[c.split()[0] for c in COUNTERS.split(", ")])
    return counted.writeStream.outputMode("update").foreachBatch(Jobs(spark, path, by, key_schema).batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(steps: DataFrame, every: int = 1000) -> DataFrame:
    """(n): the counts at which progress is told."""
    return steps.agg(F.floor(F.count(F.lit(1)) / every).alias("ticks")).select(F.explode(F.expr("filter(sequence(0, ticks), x -> x > 0)")).alias("tick")).select((F.col("tick") * every).alias("n"))
