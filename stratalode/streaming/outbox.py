"""The indexing queue as a stream: deliver, retry with longer waits, give up to the dead letters.

Rows that wait stand in folders by the time they are due, a bucket of ``width``
seconds each, like the slots of a timer wheel. A round opens the buckets that
are due and no others, and writes what it gives back into the buckets of the
new times, so its cost follows what is due, whatever waits. Which folders count
is told by a manifest that a round writes last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import jobs, store

Deliver = Callable[[DataFrame], DataFrame]


def enqueue(units: DataFrame, now) -> DataFrame:
    """Queue rows of stored units (id, project, unit_path, version, payload_json)."""
    return units.select("id", "project", "unit_path", "version", "payload_json", F.lit(0).alias("attempts"), now.alias("next_attempt_at"))


def attempted(claimed: DataFrame, deliver: Deliver, now, most: int = jobs.MOST_ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """(claimed rows delivered, the others with one attempt more and a later time).

    deliver: claimed rows to (id, ok, corrupt); a row that it doesn't answer
    has failed. Callers write the answer first, so that it is asked for once.
    """
    told = claimed.join(deliver(claimed).select("id", "ok", "corrupt"), "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("ok", "corrupt")})
    done = told.where("ok and not corrupt").select(*claimed.columns)
    return done, jobs.after_attempt(told, now, ~F.col("ok"), F.col("corrupt"), most).select(*claimed.columns)


def drain_once(queue: DataFrame, now, deliver: Deliver, most: int = jobs.MOST_ATTEMPTS, batch: int = jobs.BATCH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queue after, dead letters, delivered) of one round.

    What isn't claimed stays as it is, delivered rows go, failed ones wait,
    those out of attempts are dead.
    """
    claimed = jobs.claim(queue, now, most, batch)
    done, back = attempted(claimed, deliver, now, most)
    rest = queue.join(F.broadcast(claimed.select("id")), "id", "left_anti").unionByName(back)  # ids of a batch
    dead, alive = jobs.exhausted(rest, most)
    return alive, dead, done.select("id")


class Outbox:
    """The queue's tables under a folder: ``waiting`` by due bucket, ``delivered`` and ``dead`` by round.

    width: seconds of a bucket. keep: how many rounds can be repeated with the
    same outcome; folders that only older ones read, and their answers, go.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, deliver: Deliver, most: int = jobs.MOST_ATTEMPTS, *, width: int = 60, keep: int = 3):
        self.spark, self.path, self.schema, self.deliver, self.most, self.width, self.keep = spark, path, schema, deliver, most, width, keep

    def rounds(self) -> list[str]:
        """Names of the rounds that are over and kept, in order."""
        return [n for n in store.names(self.spark, f"{self.path}/manifests") if store.exists(self.spark, f"{self.path}/manifests/{n}/_SUCCESS")]

    def last(self) -> str | None:
        return max(self.rounds(), default=None)

    def folders(self, name: str | None = None) -> list[tuple[int, str]]:
        """(bucket, round) of the folders that count after the last round; name: the last before that one."""
        before = max((n for n in self.rounds() if name is None or n < name), default=None)
        if before is None:
            return []
        rows = self.spark.read.schema("bucket long, of string").parquet(f"{self.path}/manifests/{before}").collect()  # buckets times rounds that wrote to them
        return sorted(tuple(r) for r in rows if r.of)

    def _rows(self, folders: list[tuple[int, str]]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/waiting/{of}/bucket={bucket}" for bucket, of in folders])

    def waiting(self, name: str | None = None) -> DataFrame:
        """All rows that wait after the last round; name: the last before that one."""
        return self._rows(self.folders(name))

    def due(self, now, name: str | None = None) -> DataFrame:
        """Rows of the buckets that have begun by ``now``, a timestamp column."""
        bucket = self.spark.range(1).select(self._bucket(now)).first()[0]
        return self._rows([f for f in self.folders(name) if f[0] <= bucket])

    def _bucket(self, at):
        """A row without a time is due at once."""
        return F.coalesce(F.floor(F.unix_seconds(at.cast("timestamp")) / self.width), F.lit(0)).cast("long")

    def round(self, name: str, fresh: DataFrame | None = None, now=None) -> None:
        """Tries fresh rows and waiting ones that are due; the others wait. The same name again gives the same."""
        now = F.lit(self.spark.range(1).select(F.current_timestamp().cast("string")).first()[0] if now is None else now).cast("timestamp")
        bucket = self.spark.range(1).select(self._bucket(now)).first()[0]
        folders = self.folders(name)
        opened = [f for f in folders if f[0] <= bucket]
        before = self._rows(opened)
        if fresh is not None:
            before = before.unionByName(fresh.select(*before.columns))
        due = F.coalesce(F.col("next_attempt_at") <= now, F.lit(True))
        claimed = before.where(due)
        told = claimed.join(self.deliver(claimed).select("id", "ok", "corrupt"), "id", "left")
        told.write.mode("overwrite").parquet(f"{self.path}/answers/{name}")  # delivery is asked for once a round
        told = self.spark.read.schema(told.schema).parquet(f"{self.path}/answers/{name}")
        done, back = attempted(told.select(*before.columns), lambda _: told, now, self.most)
        dead, alive = jobs.exhausted(back, self.most)
        done.write.mode("overwrite").parquet(f"{self.path}/delivered/round={name}")
        dead.write.mode("overwrite").parquet(f"{self.path}/dead/round={name}")
        rest = before.where(~due).unionByName(alive).withColumn("bucket", self._bucket(F.col("next_attempt_at")))
        rest.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/waiting/{name}")
        written = store.numbers(self.spark, f"{self.path}/waiting/{name}", "bucket=")
        live = [f for f in folders if f not in opened] + [(b, name) for b in written]
        manifest = self.spark.createDataFrame(live or [(0, "")], "bucket long, of string")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/{name}")  # last: the round counts from here
        self._forget()

    def _forget(self) -> None:
        """Removes what no kept round reads: a round reads the folders of the one before it."""
        rounds = self.rounds()
        old, kept = rounds[: -self.keep - 1], rounds[-self.keep - 1 :]
        if not old:
            return
        read = {f for n in kept for f in self.folders(f"{n}\0")}
        gone = {f for n in old for f in self.folders(f"{n}\0")} - read
        store.remove(self.spark, *[f"{self.path}/waiting/{of}/bucket={bucket}" for bucket, of in sorted(gone)])
        live = {of for _, of in read}
        store.remove(self.spark, *[f"{self.path}/waiting/{of}" for of in {of for _, of in gone} - live])
        store.remove(self.spark, *[f"{self.path}/{kind}/{n}" for n in old for kind in ("answers", "manifests")])

    def batch(self, fresh: DataFrame, number: int) -> None:
        """A micro-batch of the stream."""
        self.round(f"{number:012}-0000", fresh)

    def retry(self, now=None) -> None:
        """A round without fresh rows, between micro-batches: what is due is tried."""
        number, _, again = (self.last() or "000000000000-0000").partition("-")
        self.round(f"{number}-{int(again) + 1:04}", now=now)


def start(spark: SparkSession, source: str, schema: str, path: str, checkpoint: str, *, deliver: Deliver, most_files: int = 1, once: bool = True, interval: str = "5 seconds") -> StreamingQuery:
    """Drains a folder of queue files as a stream into the tables of an :class:`Outbox` under path.

    Failed rows wait longer each time and are tried again by later
    micro-batches, or by :meth:`Outbox.retry` while nothing arrives.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(source)
    writer = stream.writeStream.foreachBatch(Outbox(spark, path, schema, deliver).batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def compact_dead(queue: DataFrame, now, most: int = jobs.MOST_ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """(dead letters, queue without them): the nightly job."""
    dead, alive = jobs.exhausted(queue, most)
    return dead.select("id", now.alias("failed_at"), *[c for c in ("project", "unit_path", "version", "payload_json", "last_error") if c in dead.columns]), alive
