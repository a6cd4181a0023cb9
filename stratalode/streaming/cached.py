"""Reads through a cache: values with a time to live, given up when they are written.

A key's state is the value that its table holds, told by the writes that pass
by, and the value that a read has loaded, with the time up to which it serves.
A read that finds none loads the table's value and keeps it for ``ttl``; hits
don't prolong it. A write takes the loaded value away, so that no read after it
sees an older one (``invalidate=False``: only time does). Times are event
times, so a replay gives the same hits; a timer frees the values of keys that
nobody asks for any more.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .keyed import state_session

HIT, MISS, EXPIRED, INVALIDATED = "hit", "miss", "expired", "invalidated"
READ, WRITE = "read", "write"


class Cache(StatefulProcessor):
    """rows (key columns, id, at, op, value), in order of their times, to one row a read."""

    def __init__(self, by: list[str], ttl_ms: int, invalidate: bool):
        self.by, self.ttl, self.invalidate = by, ttl_ms, invalidate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.row = handle, Row(*self.by, "id", "outcome", "value")
        self.state = handle.getValueState("state", "stored string, loaded string, until long, written boolean")  # until null: nothing was loaded yet

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        given = self.state.get()
        stored, *rest = given or (None, None, None, None)
        loaded = before = tuple(rest) if rest[1] is not None else None
        for row in sorted(rows, key=lambda r: (r["at"], r["id"])):
            at = row["millis"]
            if row["op"] == WRITE:
                stored = row["value"]
                if self.invalidate and loaded is not None and at < loaded[1]:
                    loaded = (None, loaded[1], True)
                continue
            if loaded is None:
                outcome = MISS
            elif at >= loaded[1]:
                outcome = EXPIRED
            else:
                outcome = INVALIDATED if loaded[2] else HIT
            if outcome != HIT:
                loaded = (stored, at + self.ttl, False)
            yield self.row(*key, row["id"], outcome, loaded[0])
        now = (stored, *(loaded or (None, None, None)))
        if given is None or now != tuple(given):
            self.state.update(now)
        if loaded is not None and (before is None or before[1] != loaded[1]):
            if before is not None:
                self.handle.deleteTimer(before[1])
            self.handle.registerTimer(loaded[1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        given = self.state.get()
        if given is not None and given[1] is not None:
            stored, _, until, written = given
            self.state.update((stored, None, until, written))  # its time stays, so that the next read is told as expired
        return iter(())

    def close(self) -> None:
        pass


def through_cache(stream: DataFrame, by: list[str], ttl: int, invalidate: bool = True, late: str = "10 minutes") -> DataFrame:
    """(by, id, outcome, value) of the reads of a stream (by, id, at, op, value).

    ttl: seconds. Rows of a micro-batch are taken in the order of their times;
    rows later than ``late`` behind what came before are left out, as Spark
    does, and so are rows without a key or a time. value: what the read
    returns, null where nothing was written.
    """
    kind = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    whole = stream.where(" and ".join(f"`{c}` is not null" for c in (*by, "at"))).select(*by, F.col("id").cast("long").alias("id"), F.col("at").cast("timestamp").alias("at"), "op", F.col("value").cast("string").alias("value"))
    out = ", ".join([*(f"`{c}` {kind[c]}" for c in by), "id long, outcome string, value string"])
    return whole.withWatermark("at", late).withColumn("millis", F.unix_millis("at")).groupBy(*by).transformWithState(Cache(by, ttl * 1000, invalidate), out, "Append", "EventTime")


def start(spark: SparkSession, source: str, schema: str, path: str, checkpoint: str, by: list[str], *, ttl: int, invalidate: bool = True, most_files: int = 1, partitions: int | None = None) -> StreamingQuery:
    """Serves a folder of requests, its files in order of time, into the table under path."""
    stream = state_session(spark, partitions).readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(source)
    writer = through_cache(stream, by, ttl, invalidate).writeStream.format("parquet").outputMode("append")
    return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
