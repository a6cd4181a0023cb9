"""Streams with keyed state, the due-time queue and version chains, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from stratalode.operators import versions as V
from stratalode.streaming import cached, job_tracking, ordered, outbox


def folder_bytes(path):
    return sum(p.stat().st_size for p in path.rglob("*.parquet"))


ROWS = "k string, seq int, came timestamp, said string"


def delivered(spark, root, loads, patience=60):
    for rows in loads:
        made = spark.createDataFrame([(k, seq, minute, said) for k, seq, minute, said in rows], "k string, seq int, minute int, said string")
        made = made.withColumn("came", F.lit("2024-03-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=F.col("minute"))).drop("minute")
        made.repartition(2).write.mode("append").parquet(str(root / "in"))
        ordered.start(spark, str(root / "in"), ROWS, str(root / "out"), str(root / "cp"), ["k"], "seq", "came", patience=patience, most_files=1000).awaitTermination()
    got = spark.read.parquet(str(root / "out")).collect()
    return sorted(((r.k, r.seq, r.said, r.status, r.place) for r in got), key=repr)


def test_order_gaps_and_late_rows(spark, tmp_path):
    loads = [
        [("a", 3, 0, "a3"), ("a", 1, 0, "a1"), ("b", 2, 0, "b2"), ("c", 1, 0, None), ("c", 1, 0, None)],
        [("a", 2, 0, "a2"), ("a", 6, 0, "a6"), ("a", 6, 1, "again"), ("a", 8, 1, "a8"), (None, 1, 1, "no key")],
        [("z", None, 30, "clock")],
        [("a", 5, 31, "a5"), ("b", 1, 31, "b1"), ("b", 3, 31, "b3"), ("a", 7, 31, "a7"), ("a", 9, 31, "a9")],
    ]
    want = [
        ("a", 1, "a1", "delivered", 1), ("a", 2, "a2", "delivered", 2), ("a", 3, "a3", "delivered", 3), ("a", 6, "a6", "after_gap", 4), ("a", 6, "again", "repeated", None),
        ("a", 8, "a8", "after_gap", 5), ("a", 5, "a5", "late", None), ("a", 7, "a7", "late", None), ("a", 9, "a9", "delivered", 6),
        ("b", 2, "b2", "after_gap", 1), ("b", 1, "b1", "late", None), ("b", 3, "b3", "delivered", 2), ("c", 1, None, "delivered", 1), ("c", 1, None, "late", None),
    ]
    assert delivered(spark, tmp_path / "1", loads) == sorted(want, key=repr)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")  # the caller's session is as it was


def test_shuffled_rows_come_in_order_in_any_loads(spark, tmp_path):
    rows = [(k, n, 0, f"{k}{n}") for k in "abc" for n in range(1, 40)]
    want = sorted([(k, n, said, "delivered", n) for k, n, _, said in rows], key=repr)
    for run in range(2):
        random.Random(run).shuffle(rows)
        assert delivered(spark, tmp_path / str(run), [rows[:50], rows[50:]]) == want


class CountedState:
    """A state of a processor, and how many calls went to it and entries came from it."""

    def __init__(self, calls):
        self.held, self.calls = {}, calls

    def _told(self, value, n=1):
        self.calls[0] += n
        return value

    exists = lambda self: self._told(bool(self.held))
    get = lambda self: self._told(self.held.get(()))
    update = lambda self, value: self._told(self.held.update({(): value}))
    containsKey = lambda self, key: self._told(key in self.held)  # noqa: E731, N815
    getValue = lambda self, key: self._told(self.held.get(key))  # noqa: E731, N815
    updateValue = lambda self, key, value: self._told(self.held.update({key: value}))  # noqa: E731, N815
    removeKey = lambda self, key: self._told(self.held.pop(key))  # noqa: E731, N815
    iterator = lambda self: self._told(iter(list(self.held.items())), len(self.held))
    values = lambda self: self._told(iter(list(self.held.values())), len(self.held))


class CountedHandle:
    def __init__(self):
        self.calls = [0]

    getValueState = lambda self, name, schema: CountedState(self.calls)  # noqa: E731, N815
    getMapState = lambda self, name, key, value: CountedState(self.calls)  # noqa: E731, N815
    registerTimer = deleteTimer = lambda self, at: None  # noqa: E731, N815
    getCurrentWatermarkInMs = lambda self: 1000  # noqa: E731, N815


def test_many_gaps_of_a_key_read_its_state_once(spark):
    """a timer that gave up g gaps read all rows that wait g times."""
    handle, columns = CountedHandle(), ("k", "seq", ordered.MILLIS, "said")
    processor = ordered.InOrder(["k"], "seq", ["said"], 1)
    processor.init(handle)
    rows = [dict(zip(columns, ("a", n, 0, f"a{n}"), strict=True)) for n in range(1, 3001) if n % 10]
    random.Random(1).shuffle(rows)
    out = list(processor.handleInputRows(("a",), iter(rows), handle))
    out += list(processor.handleExpiredTimer(("a",), handle, None))
    assert [r.seq for r in out] == [n for n in range(1, 3001) if n % 10] and [r.place for r in out] == list(range(1, 2701))
    assert sum(r.status == ordered.AFTER_GAP for r in out) == 299
    assert handle.calls[0] < 100


def plain_cache(rows, ttl, invalidate):
    out, state = [], {}
    for k, n, minute, op, value in sorted(rows, key=lambda r: (r[2], r[1])):
        stored, loaded = state.get(k, (None, None))
        if op == "write":
            stored = value
            if invalidate and loaded and minute < loaded[1]:
                loaded = (None, loaded[1], True)
        else:
            outcome = "miss" if not loaded else "expired" if minute >= loaded[1] else "invalidated" if loaded[2] else "hit"
            if outcome != "hit":
                loaded = (stored, minute + ttl, False)
            out.append((k, n, outcome, loaded[0]))
        state[k] = (stored, loaded)
    return sorted(out, key=repr)


@pytest.mark.parametrize("invalidate", [True, False])
def test_cached_reads(spark, tmp_path, invalidate):
    r = random.Random(3)
    rows = [(r.choice("abcd"), n, n // 2, "write" if r.random() < 0.3 else "read", f"v{n}") for n in range(240)]
    for part in (rows[:90], rows[90:91], rows[91:]):
        made = spark.createDataFrame(part, "k string, id long, minute int, op string, value string")
        made.withColumn("at", F.lit("2024-03-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=F.col("minute"))).drop("minute").write.mode("append").parquet(str(tmp_path / "in"))
        schema = "k string, id long, at timestamp, op string, value string"
        cached.start(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "cp"), ["k"], ttl=15 * 60, invalidate=invalidate, most_files=1000).awaitTermination()
    got = sorted((tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).select("k", "id", "outcome", "value").collect()), key=repr)
    assert got == plain_cache(rows, 15, invalidate)
    assert {"hit", "miss", "expired"} <= {x[2] for x in got} and (("invalidated" in {x[2] for x in got}) == invalidate)


def test_a_batch_of_jobs_writes_what_it_changed(spark, tmp_path):
    schema, by = "job long, k string", ["job"]
    feed = job_tracking.Jobs(spark, str(tmp_path / "jobs"), by, "job long")

    def load(rows):
        rows.write.mode("append").parquet(str(tmp_path / "s"))
        job_tracking.start(spark, str(tmp_path / "s"), schema, str(tmp_path / "jobs"), str(tmp_path / "cp"), by, "job long", F.col("k")).awaitTermination()

    load(spark.range(20_000).select(F.col("id").alias("job"), F.lit("processed").alias("k")))
    load(spark.createDataFrame([(7, "completed"), (9, "failed"), (30_000, "started")], schema))
    sizes = [folder_bytes(tmp_path / f"jobs/feed/version={v}") for v in (0, 1)]
    assert sizes[1] < sizes[0] / 10
    polled = {(r.job, r.status, r.nested_total) for r in feed.changes(after=0).collect()}
    assert polled == {(7, "COMPLETED", 1), (9, "FAILED", 2), (30_000, "STARTED", 0)}
    assert {r.job for r in feed.ended(after=0).collect()} == {7, 9} and feed.ended(after=1).count() == 0
    before = {tuple(r) for r in feed.table().collect()}
    assert len(before) == 20_001
    feed.compact(keep=1)
    assert not (tmp_path / "jobs/feed/version=0").exists() and {tuple(r) for r in feed.table().collect()} == before
    load(spark.createDataFrame([(7, "processed")], schema))
    feed.compact(keep=0)
    assert {(r.job, r.nested_processed) for r in feed.table().where("job in (7, 8)").collect()} == {(7, 2), (8, 1)} and feed.table().count() == 20_001


QUEUE = "id long, attempts int, next_attempt_at timestamp"


def test_a_round_opens_what_is_due(spark, tmp_path):
    """100 minutes of waiting rows, one of them due: one bucket's files are read, the others stay where they are."""
    rows = spark.range(10_000).select("id", F.lit(0).alias("attempts"), (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=(F.col("id") % 100).cast("int"))).alias("next_attempt_at"))
    box = outbox.Outbox(spark, str(tmp_path), QUEUE, lambda df: df.select("id", (F.col("id") % 200 == 0).alias("ok"), F.lit(False).alias("corrupt")))
    box.round("0", rows, now="2023-12-31 00:00:00")
    files = {str(p) for p in (tmp_path / "waiting/0").rglob("*.parquet")}
    due = box.due(F.lit("2024-01-01 00:00:30"))
    assert len(files) >= 100 and len(due.inputFiles()) <= len(files) / 50 and due.count() == 100
    box.round("1", now="2024-01-01 00:00:30")
    assert spark.read.parquet(str(tmp_path / "delivered")).count() == 50 and box.waiting().count() == 9950
    assert {(b, of) for b, of in box.folders() if of == "1"} == {(28401120, "1")}  # back after two seconds, in the same minute
    assert len(box.folders()) == 100


def test_old_rounds_are_forgotten(spark, tmp_path):
    rows = spark.range(4).select("id", F.lit(0).alias("attempts"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("next_attempt_at"))
    box = outbox.Outbox(spark, str(tmp_path), QUEUE, lambda df: df.where("false").select("id", F.lit(True).alias("ok"), F.lit(False).alias("corrupt")), most=3, keep=1)
    for day in range(1, 6):
        box.round(str(day), rows if day == 1 else None, now=f"2024-01-0{day} 00:00:00")
        box.round(str(day), rows if day == 1 else None, now=f"2024-01-0{day} 00:00:00")  # repeated: the same
    assert box.waiting().count() == 0 and spark.read.parquet(str(tmp_path / "dead")).count() == 4
    assert box.rounds() == ["4", "5"] and sorted(p.name for p in (tmp_path / "answers").iterdir()) == ["4", "5"]
    assert not any((tmp_path / "waiting").glob("[123]/bucket=*"))


def versions(spark, edges):
    return spark.createDataFrame([("p", v, parent) for v, parent in edges], "project string, version int, parent_version int")


@pytest.mark.parametrize("n", [1, 8, 9, 65, 600])
def test_chains_of_any_depth(spark, n):
    got = V.chain(versions(spark, [(v, v - 1 if v > 1 else None) for v in range(1, n + 1)]), wanted=(n,))
    assert sorted((r.anc, r.depth) for r in got.collect()) == [(v, n - v) for v in range(1, n + 1)]


def test_trees_bounds_and_rings(spark):
    r = random.Random(1)
    parent = {v: r.randrange(1, v) if v > 1 else None for v in range(1, 120)}
    tree = versions(spark, list(parent.items()))
    want = set()
    for v in parent:
        at, depth = v, 0
        while at is not None:
            want.add((v, at, depth))
            at, depth = parent[at], depth + 1
    assert {(x.version, x.anc, x.depth) for x in V.chain(tree).collect()} == want
    assert {(x.version, x.anc, x.depth) for x in V.chain(tree, most_depth=2).collect()} == {x for x in want if x[2] <= 2}
    with pytest.raises(ValueError):
        V.chain(versions(spark, [(1, 2), (2, 1), (3, 1)]))
