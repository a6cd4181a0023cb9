"""Commits of several writers, lookups by folder, users' functions and rules, guarded stages."""

from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import duckdb
import pytest
from conftest import SMALL
from oracle import assert_same, duck, plain
from pyspark.sql import functions as F

from stratalode import catalog
from stratalode.functions import given
from stratalode.operators import commits, guarded, lookup, search
from stratalode.operators import versions as V
from stratalode.plans.registry import ORACLE, QUERIES

SCHEMA = "project string, version int, n long"


def table(spark, path, **options):
    return commits.Committed(spark, str(path), SCHEMA, ["project"], **options)


def rows(spark, *given):
    return spark.createDataFrame(given, SCHEMA)


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_writers_of_other_slices_both_commit(spark, tmp_path):
    t = table(spark, tmp_path, slices=1000)
    t.upsert(rows(spark, ("a", 1, 1), ("b", 1, 1)), ["project", "version"])
    first, second = (t.prepare(rows(spark, (p, 2, 5)), lambda old, new: old.unionByName(new)) for p in "ab")
    assert (t.commit(first), t.commit(second)) == (2, 3)
    assert as_set(t.read()) == {("a", 1, 1), ("b", 1, 1), ("a", 2, 5), ("b", 2, 5)}
    assert as_set(t.read(1)) == {("a", 1, 1), ("b", 1, 1)} and as_set(t.read(0)) == set()


def test_a_writer_that_lost_the_race_starts_anew(spark, tmp_path):
    t = table(spark, tmp_path, slices=4)
    add = lambda old, new: old.unionByName(new).groupBy("project", "version").agg(F.sum("n").alias("n"))
    t.write(rows(spark, ("a", 1, 1)), add)
    slow = t.prepare(rows(spark, ("a", 1, 10)), add)
    t.write(rows(spark, ("a", 1, 100)), add)
    with pytest.raises(commits.Conflict):
        t.commit(slow)
    t.write(rows(spark, ("a", 1, 10)), add)
    assert as_set(t.read()) == {("a", 1, 111)}


def test_threads_lose_nothing_and_numbers_are_their_own(spark, tmp_path):
    """A-11: each of five writers takes the next version number of one project."""
    t = table(spark, tmp_path, slices=2)
    t.upsert(rows(spark, ("a", 0, 0)), ["project", "version"])
    following = lambda old, new: old.unionByName(new.crossJoin(old.agg((F.max("version") + 1).alias("next"))).select("project", F.col("next").alias("version"), "n"))  # noqa: E731 - one row each
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda k: t.write(rows(spark, ("a", 0, k)), following), range(1, 6)))
    got = as_set(t.read())
    assert sorted(v for _, v, _ in got) == list(range(6)) and sorted(n for *_, n in got) == list(range(6))


def test_empty_slices_and_old_entries_go(spark, tmp_path):
    t = table(spark, tmp_path, slices=3)
    for k in range(4):
        t.upsert(rows(spark, ("a", 1, k), ("b", 1, k), ("c", 1, k)), ["project", "version"])
    t.write(rows(spark, ("b", 1, 0)), lambda old, new: old.where("project <> 'b'"))
    before = as_set(t.read())
    assert before == {("a", 1, 3), ("c", 1, 3)}
    t.forget(keep=1)
    assert as_set(t.read()) == before and len(list((tmp_path / "log").glob("*.json"))) == 1
    assert t.upsert(rows(spark, ("a", 1, 9)), ["project", "version"]) == 6
    with pytest.raises(ValueError):
        t.write(rows(spark, ("a", 1, 9)), lambda old, new: new.withColumn("project", F.lit("not where it was" * 3)))


def test_guard_of_finalised_versions(spark, tmp_path):
    """V-05: what a merge refuses isn't committed."""
    t = table(spark, tmp_path)
    versions = spark.createDataFrame([("a", 1, "FINALIZED"), ("a", 2, "OPEN")], "project string, version int, status string")
    t.write(rows(spark, ("a", 1, 1), ("a", 2, 2), ("b", 1, 3)), lambda old, new: old.unionByName(V.writable(new, versions).select(*old.columns)))
    assert as_set(t.read()) == {("a", 2, 2), ("b", 1, 3)}


def test_find_unit_opens_its_own_folder(spark, tmp_path):
    n = 300
    units = spark.range(n).select("id", F.lit("p").alias("project"), F.lit(1).alias("version"), F.lit("CLASS_FILE").alias("source_kind"), F.concat(F.lit("u"), "id").alias("path"))
    constants = spark.range(n * 4).select("id", (F.col("id") % n).alias("snapshot_id"), F.concat(F.lit("c"), "id").alias("constant_value"), F.lit("String").alias("constant_value_type"))
    usages = spark.range(n * 8).select((F.col("id") % (n * 4)).alias("constant_id"), F.lit("FIELD_STORE").alias("structural_type"), F.lit("CORE").alias("semantic_type_kind"), F.lit("UNKNOWN").alias("semantic_type_name"))
    usages = usages.withColumns({"location_method_name": F.lit("m"), "location_line_number": F.lit(1), "confidence": F.lit(0.5)})
    frames = {"unit_descriptors": units, "unit_snapshots": units.select("id", F.col("id").alias("descriptor_id"), F.col("path").alias("unit_name")), "unit_constants": constants, "constant_usages": usages}
    frames |= {"project_versions": spark.createDataFrame([("p", 1, None, "OPEN")], "project string, version int, parent_version int, status string"), "version_deletions": spark.createDataFrame([], "project string, version int, unit_path string")}
    catalog.write_tables(frames, str(tmp_path))
    cat = catalog.Catalogue.at(spark, str(tmp_path))
    got = {(r.value, len(r.usages)) for r in lookup.find_unit(cat, "p", "u7", 1).collect()}
    assert got == {(f"c{7 + n * k}", 2) for k in range(4)}
    assert lookup.find_unit(cat, "p", "none", 1).count() == 0
    for own, name in zip(cat.of_unit(7), ("unit_constants", "constant_usages"), strict=True):
        read = own.select("_metadata.file_path").distinct().count()
        assert 1 <= read <= 4 and len(list((tmp_path / name).rglob("*.parquet"))) >= 32
    assert cat.usages.count() == n * 8
    bloom = duckdb.execute(f"SELECT count(bloom_filter_offset), count(*) FROM parquet_metadata('{tmp_path}/unit_snapshots/*.parquet') WHERE path_in_schema='unit_name'").fetchone()
    assert bloom[0] == bloom[1] > 0


def test_units_that_share_a_constants_id_get_each_usage_once(spark, tmp_path):
    """Ids repeat in the views from 1,000,000 parts on; a scan must not count a usage once per unit."""
    part = spark.createDataFrame([(5, "a", "B1", 4), (1_000_005, "b", "B2", 5)], "p_partkey long, p_name string, p_brand string, p_size int")
    lines = [(1, 1, 1_000_005, 1, 0.1, 1995), (1, 2, 1_000_005, 2, 0.2, 1995), (2, 1, 5, 3, 0.3, 1996), (3, 1, 5, 3, 0.3, 1995)]
    line = spark.createDataFrame([(o, n, k, s, d, f"{y}-05-01") for o, n, k, s, d, y in [(o, n, k, 3, d, y) for o, n, k, _, d, y in lines]], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_discount double, day string")
    line = line.select("*", F.lit("A").alias("l_returnflag"), F.lit("F").alias("l_linestatus"), F.col("day").cast("timestamp_ntz").alias("l_shipdate")).drop("day")
    made = {"part": part, "lineitem": line, "supplier": spark.createDataFrame([(3, "S3", 0)], "s_suppkey long, s_name string, s_nationkey int")}
    made |= {"nation": spark.createDataFrame([(0, 0)], "n_nationkey int, n_regionkey int"), "region": spark.createDataFrame([(0, "ASIA")], "r_regionkey int, r_name string")}
    for name, rows in made.items():
        rows.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    cat = catalog.Catalogue.over(spark, str(tmp_path))
    assert cat.constants.count() > cat.constants.select("id").distinct().count()
    for name in ("A06_A08_usages_by_value", "A09_merged_constants", "C20_metadata_json", "F14_projection_whole", "J03_A03_usage_details", "O02_details_page", "J06_usages_per_constant", "O07_rows_whole", "V12_V13_J08_O05_C19_constant_diff", "X05_find_unit"):
        assert_same_tables(QUERIES[name](spark, str(tmp_path)), ORACLE[name], tmp_path)


def test_rows_of_one_value_come_in_one_order(spark):
    """the SQL's order leaves usages of one value open; the query's doesn't."""
    rows = [tuple(r) for r in QUERIES["O07_rows_whole"](spark, SMALL).collect()]
    assert len({r[:2] for r in rows}) < len(set(rows)) and rows == sorted(rows)


def altered(folder, *changes):
    """A folder of the catalogue's test tables, changed by SQL."""
    con, tables = duckdb.connect(), ("region", "nation", "supplier", "part", "lineitem")
    for table in tables:
        con.execute(f"CREATE TABLE {table} AS SELECT * FROM '/root/testdata/sf0.01/{table}.parquet'")
    for change in changes:
        con.execute(change)
    for table in tables:
        con.execute(f"COPY {table} TO '{folder}/{table}.parquet' (FORMAT parquet)")
    return str(folder)


def test_page_of_details_has_nulls_last(spark, tmp_path):
    """F8: where a value, confidence or metadata is null, the page holds other rows if nulls come first."""
    folder = altered(tmp_path, "UPDATE part SET p_brand=NULL WHERE p_partkey%7=1", "UPDATE part SET p_name=NULL WHERE p_partkey%11=2", "UPDATE lineitem SET l_discount=NULL WHERE l_orderkey%5=1")
    got = QUERIES["O02_details_page"](spark, folder)
    want = duck(folder).execute(ORACLE["O02_details_page"]).fetchall()
    assert [tuple(map(plain, r)) for r in got.collect()] == [tuple(map(plain, r)) for r in want] and len(want) == 100
    assert any(None in r for r in want)


def test_metadata_without_an_owner_is_null(spark, tmp_path):
    """it was an object without fields."""
    folder = altered(tmp_path, "UPDATE part SET p_brand=NULL WHERE p_partkey%7=1")
    got = QUERIES["C20_metadata_json"](spark, folder)
    assert_same(got, ORACLE["C20_metadata_json"], folder)
    assert 0 < got.where("metadata is null").count() < got.count()


def test_merged_constants_of_a_unit_in_scope_twice(spark, tmp_path):
    """a supplier's row that repeats gives its unit twice, and the SQL counts its usages for each pair."""
    folder = altered(tmp_path, "INSERT INTO supplier SELECT * FROM supplier WHERE s_suppkey%4=0")
    assert_same(QUERIES["A09_merged_constants"](spark, folder), ORACLE["A09_merged_constants"], folder)


@pytest.mark.parametrize("change", ["DELETE FROM lineitem", "DELETE FROM supplier", "UPDATE lineitem SET l_partkey=NULL"])
def test_tables_without_rows_are_read(spark, tmp_path, change):
    """a table in folders had no file, so no columns, where it had no rows."""
    folder = altered(tmp_path, change)
    for name in ("F14_projection_whole", "J03_A03_usage_details", "J06_usages_per_constant", "O02_details_page", "C20_metadata_json", "A09_merged_constants"):
        got = QUERIES[name](spark, folder)
        assert_same(got, ORACLE[name], folder)
        assert got.count() == 0
    constants, usages = catalog.Catalogue.over(spark, folder).of_unit(7)
    assert constants.count() == usages.count() == 0


def assert_same_tables(df, sql, folder):
    """oracle.assert_same over tables that Spark wrote, each a folder of files."""
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}/*.parquet'")
    con.execute(sql)
    columns = sorted(d[0] for d in con.description)
    places = [[d[0] for d in con.description].index(c) for c in columns]
    want = sorted(repr(tuple(plain(row[k]) for k in places)) for row in con.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect()) == want


def test_tables_are_written_when_they_are_asked_for(spark, tmp_path):
    """A version is looked up without the fact tables."""
    folder = tmp_path / "given"
    folder.symlink_to(SMALL)
    assert QUERIES["V14_get_version"](spark, str(folder)).count() == 1
    root = Path(catalog.Catalogue.over(spark, str(folder)).root.removeprefix("file:"))
    assert sorted(p.name for p in root.iterdir()) == ["project_versions"]
    assert QUERIES["V08_inherited_paths"](spark, str(folder)).count() > 0
    assert sorted(p.name for p in root.iterdir()) == ["project_versions", "unit_descriptors", "unit_snapshots", "version_deletions"]


def test_table_functions_keep_failures_apart(spark):
    given.register_extractor(spark, "halves", lambda text: [(int(x), x) for x in text.split(";")], "n int, said string")
    made = spark.createDataFrame([(1, "4;5"), (2, "x"), (3, None), (4, "6")], "id int, v string")
    got = {(r.id, r.n, r.said, r.error and r.error.split(":")[0]) for r in given.extracted(made, "halves", "v").collect()}
    assert got == {(1, 4, "4", None), (1, 5, "5", None), (2, None, None, "ValueError"), (4, 6, "6", None)}


def test_rules_in_order_of_confidence(spark):
    values = spark.createDataFrame([("Select a row",), ("a row",), ("nothing",), (None,)], "v string")
    rules = spark.createDataFrame([("select", "SQL", 0.9), ("row", "GRID", 0.9), ("row", "ROW", 0.95), (None, "BAD", 1.0), ("a", "BAD", None)], "word string, semantic string, confidence double")
    got = {r.v: (r.semantic, r.confidence) for r in given.by_rules(values, "v", rules).collect()}
    assert got == {"Select a row": ("ROW", 0.95), "a row": ("ROW", 0.95), "nothing": (None, None), None: (None, None)}


def test_guarded_stage(spark, tmp_path):
    made = guarded.guarded(spark.range(2500), F.when(F.col("id") % 500 == 3, F.concat(F.lit("bad "), "id")))
    told = []
    counts = guarded.run(made, str(tmp_path / "a"), budget=0.01, notify=lambda *x: told.append(x), name="numbers")
    assert counts == {"rows": 2500, "errors": 5, "first_error": "bad 1003", "ticks": 2}
    assert told == [("numbers", 1000, None), ("numbers", 2000, None), ("numbers", 2500, 5)]
    got = spark.read.parquet(str(tmp_path / "a"))
    assert {r.outcome: r["count"] for r in got.groupBy("outcome").count().collect()} == {"ok": 2495, "failed": 5}
    with pytest.raises(guarded.BudgetExceeded, match="5 of 2500"):
        guarded.run(made, str(tmp_path / "b"), budget=0.001, name="numbers-again")


def test_progress_of_a_stream(spark, tmp_path):
    for k in range(3):
        spark.range(100 * k, 100 * k + 100).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    told = []
    listener = guarded.Progress("stream", lambda *x: told.append(x))
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        checked = guarded.guarded(stream, F.when(F.col("id") % 50 == 0, "fifty")).observe("stream", *guarded.metrics())
        checked.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        for _ in range(50):
            if told and told[-1][1] == 300:
                break
            import time

            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert told[-1] == ("stream", 300, 6) and len(told) >= 3


def test_chunks_of_containers_over_many_parts(spark):
    from stratalode.operators import store

    made = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("n"), F.when(F.col("id") % 10 == 0, F.lit(None).cast("string")).when(F.col("id") % 3 == 0, "small").otherwise("hot").alias("container"))
    got = store.chunk(made.repartition(6), ["container"], "n", size=100).collect()
    for name in (None, "small", "hot"):
        own = sorted((r.n, r.chunk, r["first"]) for r in got if r.container == name)
        assert [(c, f) for _, c, f in own] == [(k // 100, k < 100) for k in range(len(own))]
    assert len(got) == 5000


def test_one_shuffle_makes_constants_distinct_and_places_them(spark):
    """nothing is sampled for ranges; the rows of a folder and slice stand in one task."""
    made = spark.range(400).select((F.col("id") % 100).alias("id"), (F.col("id") % 10).alias("snapshot_id")).withColumn("bucket", catalog.bucket_of(F.col("snapshot_id")))
    placed = catalog._in_folders(made, "id", 3).distinct()
    assert placed._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = placed.withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r.id for r in got) == list(range(100))
    tasks = {}
    for r in got:
        tasks.setdefault((r.bucket, r._slice), set()).add(r.task)
    assert len(tasks) > 10 and all(len(t) == 1 for t in tasks.values())


def test_documents_of_a_project_gather_its_constants_only(spark):
    """the same documents, from constants that are restricted before they are joined with usages."""
    cat = catalog.Catalogue.over(spark, SMALL)
    want = sorted(map(repr, search.documents(cat).where("project = 'ASIA'").collect()))
    asia = search.documents(cat, "ASIA")
    assert sorted(map(repr, asia.collect())) == want != []
    assert "LeftSemi" in asia._jdf.queryExecution().optimizedPlan().toString()
