"""Progress and failures of a stage, told by the pass that does the work.

Rows that fail stay rows: they carry their error and are written beside the
others. Counts and ticks are metrics that Spark observes while the rows go by,
so nothing is read twice. A stage whose failures exceed its budget fails as a
whole, once it is through, with its first errors in the message.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

Notify = Callable[[str, int, int | None], None]


class BudgetExceeded(Exception):
    """More rows failed than the stage may lose."""


def metrics() -> list[Column]:
    """What is observed of rows with ``error``."""
    return [F.count(F.lit(1)).alias("rows"), F.count("error").alias("errors"), F.min("error").alias("first_error")]


def guarded(rows: DataFrame, error: Column) -> DataFrame:
    """rows with ``error``: what is wrong with each, null of those that are right."""
    return rows.withColumn("error", error.cast("string"))


def run(rows: DataFrame, path: str, *, budget: float = 0.01, every: int = 1000, notify: Notify | None = None, name: str = "stage") -> dict:
    """Writes rows (with ``error``) under path/ok and path/failed and tells {rows, errors, first_error, ticks}.

    budget: the share of rows that may fail. notify: called when the pass is
    over, with (name, rows, None) for each tick of ``every`` rows, then with all
    rows and errors; a stream tells them as it goes, see :class:`Progress`.
    """
    seen = Observation(name)
    told = rows.observe(seen, *metrics()).withColumn("outcome", F.when(F.col("error").isNull(), "ok").otherwise("failed"))
    told.write.mode("overwrite").partitionBy("outcome").parquet(path)
    counts = dict(seen.get)
    counts["ticks"] = counts["rows"] // every
    if notify is not None:
        for tick in range(1, counts["ticks"] + 1):
            notify(name, tick * every, None)
        notify(name, counts["rows"], counts["errors"])
    if counts["errors"] > budget * counts["rows"]:
        raise BudgetExceeded(f"{name}: {counts['errors']} of {counts['rows']} rows failed, of which {budget:.2%} may; such as {counts['first_error']}")
    return counts


class Progress(StreamingQueryListener):
    """Tells a stream's observed ``rows`` and ``errors``, summed over its micro-batches."""

    def __init__(self, name: str, notify: Notify):
        self.name, self.notify, self.rows, self.errors = name, notify, 0, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None:
            self.rows, self.errors = self.rows + seen["rows"], self.errors + seen["errors"]
            self.notify(self.name, self.rows, self.errors)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
