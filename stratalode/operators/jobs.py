"""Archive jobs and the indexing queue, as batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import backoff_seconds

MOST_ATTEMPTS, BATCH = 10, 50


def claim(queue: DataFrame, now, most: int = MOST_ATTEMPTS, batch: int = BATCH) -> DataFrame:
    """The next entries that are due, by id."""
    return queue.where((F.col("next_attempt_at") <= now) & (F.col("attempts") < most)).orderBy("id").limit(batch)


def exhausted(queue: DataFrame, most: int = MOST_ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """(entries that are tried no more, the rest)."""
    return queue.where(F.col("attempts") >= most), queue.where(F.col("attempts") < most)


def after_attempt(claimed: DataFrame, now, failed, corrupt, most: int = MOST_ATTEMPTS) -> DataFrame:
    """Entries that stay after an attempt: failed ones wait longer each time, corrupt ones are tried no more; done ones go."""
    attempts = F.when(corrupt, F.lit(most)).otherwise(F.col("attempts") + 1)
    wait = F.make_dt_interval(secs=backoff_seconds(F.col("attempts")).cast("decimal(18,6)"))
    return claimed.where(failed | corrupt).withColumn("next_attempt_at", F.when(corrupt, F.col("next_attempt_at")).otherwise(now + wait)).withColumn("attempts", attempts)


def latest_jobs(jobs: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """The latest row of each key."""
    rest = [c for c in jobs.columns if c not in keys]
    return jobs.groupBy(*keys).agg(F.max_by(F.struct(*rest), id_col).alias("r")).select(*keys, "r.*")


def job_counters(steps: DataFrame, by: list[str]) -> DataFrame:
    """Counters of jobs from their steps (kind: started, processed, failed, completed)."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    status = F.when(n("completed") > 0, "COMPLETED").when(n("failed") > 0, "FAILED").otherwise("STARTED")
    return steps.groupBy(*by).agg(n("processed").alias("nested_processed"), n("failed").alias("nested_failed"), (n("processed") + n("failed")).alias("nested_total"), status.alias("status"))


def carry_forward(rows: DataFrame, by: list[str], order: list[str], col: str, as_: str) -> DataFrame:
    """rows with the last value of ``col`` up to each row."""
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(as_, F.last(col, ignorenulls=True).over(window))


def valid_tokens(tokens: DataFrame, now) -> DataFrame:
    """Tokens that are neither revoked nor past their time."""
    return tokens.where(~F.col("revoked") & (F.col("expires_at") > now))


def unexpired(tokens: DataFrame, now) -> DataFrame:
    """What a purge leaves."""
    return tokens.where(~(F.col("expires_at") < now))
