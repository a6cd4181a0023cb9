"""Queries that show users and tokens, the queue and jobs as streams, and what a service asks for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import access, service, store
from ..operators.versions import VersionConflict
from ..streaming import job_tracking, outbox
from .registry import NOW, example, table_query

USERS = "SELECT c_custkey AS id, c_name AS name, c_custkey%7<>0 AS enabled, NULL::TIMESTAMP AS last_login FROM customer"
TOKENS = "SELECT event_id AS token, user_id, event_type='error' AS revoked, ts AS expires_at FROM events"


def _users(customer):
    return customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_custkey") % 7 != 0).alias("enabled"), F.lit(None).cast("timestamp_ntz").alias("last_login"))


def _tokens(events):
    return events.select(F.col("event_id").alias("token"), "user_id", (F.col("event_type") == "error").alias("revoked"), F.col("ts").alias("expires_at"))


NAMES = ["Customer#000000003", "Customer#000000007", "Customer#000000010", "nobody"]


@table_query("AU01_find_users", "customer", f"SELECT id, name FROM ({USERS}) WHERE enabled AND name IN ({', '.join(repr(n) for n in NAMES)})")
def _(customer):
    return access.find_users(_users(customer), "name", NAMES).select("id", "name")


@table_query("AU01_logged_in", "customer", f"SELECT id, CASE WHEN enabled THEN TIMESTAMP '{NOW}' ELSE last_login END AS last_login FROM ({USERS})")
def _(customer):
    users = _users(customer)
    return access.logged_in(users, users.where("enabled"), F.lit(NOW).cast("timestamp_ntz")).select("id", "last_login")


@table_query("AU02_rotated_tokens", "events", f"SELECT token, user_id, revoked OR user_id%5=0 AS revoked FROM ({TOKENS}) UNION ALL SELECT DISTINCT -user_id-1, user_id, false FROM ({TOKENS}) WHERE user_id%5=0")
def _(events):
    tokens = _tokens(events)
    issued = tokens.where("user_id % 5 = 0").select((-F.col("user_id") - 1).alias("token"), "user_id", F.lit(False).alias("revoked"), "expires_at").dropDuplicates(["token"])
    return access.rotate(tokens, issued).select("token", "user_id", "revoked")


@table_query(
    "AU03_blocked_tokens",
    "events",
    f"SELECT token, coalesce(expires_at > TIMESTAMP '{NOW}' AND revoked, false) AS blocked, CASE WHEN expires_at > TIMESTAMP '{NOW}' AND revoked THEN CASE WHEN token%2=0 THEN 'cache' ELSE 'table' END END AS source FROM ({TOKENS})",
)
def _(events):
    tokens = _tokens(events)
    revoked = tokens.where("revoked").select("token", "expires_at")
    return access.blocked(tokens.select("token"), revoked.where("token % 2 = 0"), revoked, F.lit(NOW).cast("timestamp"))


@example("X10_health", "SELECT 'UP' AS status")
def _(spark, sf_dir):
    return service.health(spark).select("status")


@example("X09_error_statuses", "SELECT * FROM (VALUES ('bad argument', 400), ('no rights', 401), ('missing', 404), ('finalized', 409), ('content', 422), ('other', 500)) t(failure, status)")
def _(spark, sf_dir):
    errors = {"bad argument": ValueError(), "no rights": PermissionError(), "missing": KeyError(), "finalized": VersionConflict(), "content": service.Unprocessable(), "other": RuntimeError()}
    return spark.createDataFrame([(k, service.status_of(e)) for k, e in errors.items()], "failure string, status int")


@table_query("A17_pages", "part", "SELECT p_partkey, p_name FROM (SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 350)")
def _(part):
    """Seven pages of 50."""
    return service.paged(part, ["p_name", "p_partkey"], size=50, most=7).select("p_partkey", "p_name")


OUTBOX = "SELECT event_id AS id, 'p' AS project, event_type AS unit_path, 1 AS version, props AS payload_json, user_id%12 AS attempts, ts AS next_attempt_at FROM events"
ENDS = "CASE WHEN event_type='error' OR event_id%17=0 THEN CASE WHEN event_type='error' THEN 'dead' WHEN user_id%12+1>=10 THEN 'dead' ELSE 'waiting' END ELSE 'delivered' END"


@table_query("T03_T04_outbox_stream", "events", f"SELECT {ENDS} AS outcome, count(*) AS n FROM events GROUP BY 1")
def _(events):
    """One pass of the stream over a queue that is due: errors are corrupt, every 17th id isn't answered."""
    spark, root = events.sparkSession, store.work_folder(events.sparkSession, "outbox")
    schema = "id long, project string, unit_path string, version int, payload_json string, attempts int, next_attempt_at timestamp"
    columns = [F.col("event_id").alias("id"), F.lit("p").alias("project"), F.col("event_type").alias("unit_path"), F.lit(1).alias("version"), F.col("props").alias("payload_json")]
    queue = events.select(*columns, (F.col("user_id") % 12).cast("int").alias("attempts"), F.col("ts").cast("timestamp").alias("next_attempt_at"))
    queue.write.parquet(f"{root}/queue")

    def deliver(rows):
        return rows.where("id % 17 <> 0 OR unit_path = 'error'").select("id", F.lit(True).alias("ok"), (F.col("unit_path") == "error").alias("corrupt"))

    outbox.start(spark, f"{root}/queue", schema, f"{root}/tables", f"{root}/offsets", deliver=deliver, most_files=100_000).awaitTermination()  # one micro-batch
    ends = {"delivered": spark.read.parquet(f"{root}/tables/delivered"), "dead": spark.read.parquet(f"{root}/tables/dead"), "waiting": outbox.Outbox(spark, f"{root}/tables", schema, deliver).waiting()}
    rows = [df.select(F.lit(name).alias("outcome")) for name, df in ends.items()]
    return rows[0].union(rows[1]).union(rows[2]).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


STEPS = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'processed' END"


@table_query(
    "T06_job_stream",
    "events",
    f"SELECT job, count(*) FILTER (k='processed') AS nested_processed, count(*) FILTER (k='failed') AS nested_failed, count(*) FILTER (k IN ('processed','failed')) AS nested_total, CASE WHEN count(*) FILTER (k='completed')>0 THEN 'COMPLETED' WHEN count(*) FILTER (k='failed')>0 THEN 'FAILED' ELSE 'STARTED' END AS status FROM (SELECT user_id AS job, {STEPS} AS k FROM events) GROUP BY job",
)
def _(events):
    """Counters of jobs from a stream of their steps, in two runs of it."""
    spark, root = events.sparkSession, store.work_folder(events.sparkSession, "jobs")
    steps = events.select("event_id", F.col("user_id").cast("long").alias("job"), F.expr(STEPS).alias("k"))
    for odd in (0, 1):
        steps.where(F.col("event_id") % 2 == odd).select("job", "k").write.mode("append").parquet(f"{root}/steps")
        job_tracking.start(spark, f"{root}/steps", "job long, k string", f"{root}/table", f"{root}/offsets", ["job"], "job long", F.col("k")).awaitTermination()
    return job_tracking.Jobs(spark, f"{root}/table", ["job"], "job long").table()
