"""Queries over events as streams with keyed state: ordered delivery, cached reads, changes of jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import store
from ..streaming import cached, job_tracking, ordered, outbox
from .registry import table_query
from .services import STEPS

PARTITIONS = 8  # of the streams' state: some thousand keys

ORDERED = """WITH s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, event_id%23=5 AS held FROM events),
 m AS (SELECT user_id, coalesce(max(seq) FILTER (NOT held), 0) AS top FROM s GROUP BY user_id),
 t AS (SELECT s.*, CASE WHEN held AND seq<top THEN 'late' WHEN NOT held AND lag(held) OVER (PARTITION BY s.user_id ORDER BY seq) THEN 'after_gap' ELSE 'delivered' END AS status FROM s JOIN m ON m.user_id=s.user_id)
 SELECT user_id, seq, event_id, status, CASE WHEN status<>'late' THEN row_number() OVER (PARTITION BY user_id, status='late' ORDER BY seq) END AS place FROM t"""


@table_query("T02_ordered_delivery", "events", ORDERED)
def delivered(events):
    """Events numbered by user, sent in two shuffled loads; every 23rd is held back until its gap has timed out."""
    spark, root = events.sparkSession, store.work_folder(events.sparkSession, "ordered")
    numbered = events.select("user_id", "event_id", F.expr("row_number() OVER (PARTITION BY user_id ORDER BY event_id)").alias("seq"))
    held, came = F.col("event_id") % 23 == 5, F.lit("2024-03-01 00:00:00").cast("timestamp")
    odd = F.xxhash64("event_id") % 2 == 0
    clock = numbered.limit(1).withColumn("seq", F.lit(None).cast("int"))
    loads = ((numbered.where(~held & odd), 0), (numbered.where(~held & ~odd), 1), (clock, 120), (numbered.where(held), 121))
    for rows, minutes in loads:
        rows.withColumn("came", came + F.make_dt_interval(mins=F.lit(minutes))).write.mode("append").parquet(f"{root}/loads")
        query = ordered.start(spark, f"{root}/loads", "user_id long, event_id long, seq int, came timestamp", f"{root}/out", f"{root}/offsets", ["user_id"], "seq", "came", patience=1800, most_files=100_000, partitions=PARTITIONS)
        query.awaitTermination()
    return spark.read.schema("user_id long, seq long, event_id long, status string, place long").parquet(f"{root}/out")


READS = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_ms(ts) AS ts, event_type='purchase' AS w, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 r AS (SELECT user_id, event_id, k, CASE WHEN w THEN event_id END AS stored, CASE WHEN NOT w THEN ts+21600000 END AS until, NULL::BIGINT AS loaded, false AS dirty, CASE WHEN NOT w THEN 'miss' END AS outcome FROM e WHERE k=1
 UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN w THEN e.event_id ELSE stored END,
  CASE WHEN w OR (until IS NOT NULL AND ts<until AND NOT dirty) THEN until ELSE ts+21600000 END,
  CASE WHEN w AND until IS NOT NULL AND ts<until THEN NULL WHEN w OR (until IS NOT NULL AND ts<until AND NOT dirty) THEN loaded ELSE stored END,
  w AND (dirty OR (until IS NOT NULL AND ts<until)),
  CASE WHEN w THEN NULL WHEN until IS NULL THEN 'miss' WHEN ts>=until THEN 'expired' WHEN dirty THEN 'invalidated' ELSE 'hit' END
  FROM r JOIN e ON e.user_id=r.user_id AND e.k=r.k+1)
 SELECT user_id, event_id, outcome, loaded::VARCHAR AS value FROM r WHERE outcome IS NOT NULL"""


@table_query("T09_AU03_cached_reads", "events", READS)
def cached_reads(events):
    """Reads of what a user's last purchase wrote, through a cache of six hours, in three runs of the stream."""
    spark, root = events.sparkSession, store.work_folder(events.sparkSession, "cached")
    write = F.col("event_type") == "purchase"
    rows = events.select("user_id", F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), F.when(write, cached.WRITE).otherwise(cached.READ).alias("op"), F.when(write, F.col("event_id").cast("string")).alias("value"))
    for first, last in ((1, 10), (11, 20), (21, 31)):
        rows.where(F.dayofmonth("at").between(first, last)).write.mode("append").parquet(f"{root}/requests")
        schema = "user_id long, id long, at timestamp, op string, value string"
        cached.start(spark, f"{root}/requests", schema, f"{root}/out", f"{root}/offsets", ["user_id"], ttl=6 * 3600, most_files=100_000, partitions=PARTITIONS).awaitTermination()
    return spark.read.schema("user_id long, id long, outcome string, value string").parquet(f"{root}/out").withColumnRenamed("id", "event_id")


COUNTS = "count(*) FILTER (k='processed') AS nested_processed, count(*) FILTER (k='failed') AS nested_failed, count(*) FILTER (k IN ('processed','failed')) AS nested_total, CASE WHEN count(*) FILTER (k='completed')>0 THEN 'COMPLETED' WHEN count(*) FILTER (k='failed')>0 THEN 'FAILED' ELSE 'STARTED' END AS status"


@table_query(
    "T06_T08_job_changes",
    "events",
    f"WITH s AS (SELECT user_id AS job, event_id%3 AS version, {STEPS} AS k FROM events), v AS (SELECT DISTINCT job, version FROM s) SELECT v.job, v.version, {COUNTS} FROM v JOIN s ON s.job=v.job AND s.version<=v.version GROUP BY v.job, v.version",
)
def job_changes(events):
    """What polls after each of three micro-batches see: the jobs that it changed, as they then are."""
    spark, root = events.sparkSession, store.work_folder(events.sparkSession, "changes")
    steps = events.select("event_id", F.col("user_id").cast("long").alias("job"), F.expr(STEPS).alias("k"))
    feed = job_tracking.Jobs(spark, f"{root}/table", ["job"], "job long")
    polls = []
    for third in range(3):
        steps.where(F.col("event_id") % 3 == third).select("job", "k").write.mode("append").parquet(f"{root}/steps")
        job_tracking.start(spark, f"{root}/steps", "job long, k string", f"{root}/table", f"{root}/offsets", ["job"], "job long", F.col("k")).awaitTermination()
        polls.append(feed.changes(after=third - 1))
    return polls[0].union(polls[1]).union(polls[2])


ROUNDS = ("2024-01-10 00:00:00", "2024-01-20 00:00:00")
DUE = f"""WITH q AS (SELECT event_id AS id, user_id%12 AS a, event_type='error' AS bad, event_id%17=0 AS silent,
  CASE WHEN ts<=TIMESTAMP '{ROUNDS[0]}' THEN 2 WHEN ts<=TIMESTAMP '{ROUNDS[1]}' THEN 1 ELSE 0 END AS tries FROM events)
 SELECT id, CASE WHEN tries=0 THEN 'waiting' WHEN bad THEN 'dead' WHEN NOT silent THEN 'delivered' WHEN a+1>=10 OR (tries=2 AND a+2>=10) THEN 'dead' ELSE 'waiting' END AS outcome,
  CASE WHEN tries=0 OR (NOT bad AND NOT silent) THEN a WHEN bad THEN 10 WHEN a+1>=10 THEN a+1 ELSE a+tries END AS attempts FROM q"""


@table_query("T04_T05_due_queue", "events", DUE)
def due_queue(events):
    """Two rounds of the queue, ten days apart: each opens what is due by then; errors are corrupt, every 17th id isn't answered."""
    spark, root = events.sparkSession, store.work_folder(events.sparkSession, "wheel")
    schema = "id long, unit_path string, attempts int, next_attempt_at timestamp"
    queue = events.select(F.col("event_id").alias("id"), F.col("event_type").alias("unit_path"), (F.col("user_id") % 12).cast("int").alias("attempts"), F.col("ts").cast("timestamp").alias("next_attempt_at"))

    def deliver(rows):
        return rows.where("id % 17 <> 0 OR unit_path = 'error'").select("id", F.lit(True).alias("ok"), (F.col("unit_path") == "error").alias("corrupt"))

    box = outbox.Outbox(spark, root, schema, deliver, width=86_400)
    box.round("0", queue, now=ROUNDS[0])
    box.round("1", now=ROUNDS[1])
    ends = {"delivered": spark.read.schema(schema).parquet(f"{root}/delivered"), "dead": spark.read.schema(schema).parquet(f"{root}/dead"), "waiting": box.waiting()}
    rows = [df.select("id", F.lit(name).alias("outcome"), "attempts") for name, df in ends.items()]
    return rows[0].union(rows[1]).union(rows[2])
