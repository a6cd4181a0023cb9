"""The pipeline's stages against plain versions of what they keep."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute
from conftest import SMALL

import corpus_pipeline
from stratalode.llm import common
from stratalode.llm.common import Scratch, table


@pytest.fixture(scope="module")
def stages(spark):
    """Rows of documents before the first stage and after each one."""
    scratch, docs = Scratch(spark, "test-pipeline"), table(spark, SMALL, "documents")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = scratch.write(stage(spark, docs, SMALL), name)
    return out


def rows(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact", "near", "pii", "packing"]
    assert all(stages[n].columns == stages["documents"].columns for n in names[:-1])


def test_quality_keeps_labelled_good_ones(spark, stages):
    labels = table(spark, SMALL, "labels")
    kept = set(rows(stages["quality"]))
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    assert len(good & kept) >= 0.97 * len(good) and len(bad & kept) <= 0.2 * len(bad)


def test_exact_and_near(stages):
    before = rows(stages["quality"])
    want = {k for k, v in brute.exact(list(before.items())).items() if v[0] == k}
    assert set(rows(stages["exact"])) == want
    sets = brute.jaccard(list(rows(stages["exact"]).items()))
    assert set(rows(stages["near"])) == {k for k, (_, c) in sets.items() if k == c}


def test_private_data_goes_and_the_rest_stays(stages):
    before, after = rows(stages["near"]), rows(stages["pii"])
    assert set(before) == set(after)
    changed = 0
    for k, t in before.items():
        if brute.pii(t):
            changed += 1
            assert not brute.pii(after[k])
        else:
            assert after[k] == t
    assert changed
    assert stages["pii"].where(F.length("text") != F.col("n_chars")).count() == 0


def test_packing_holds_all(stages):
    packed = stages["packing"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all"))
    got = {r.doc_id: (r.n, r["all"]) for r in packed.collect()}
    assert set(got) == set(rows(stages["pii"])) and all(n == a for n, a in got.values())


def test_run_gives_the_stages_rows(spark, stages):
    assert corpus_pipeline.run(spark, SMALL).count() == stages["packing"].count()


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_stages_of_odd_rows(spark, tmp_path, kind):
    """Nulls in any column, repeated rows and ids, and further columns with the operators' own names."""
    extra = ["n", "h", "sha", "kept", "keep_id", "component_id", "spans", "score", "label", "predicted", "class", "told", "record"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    good = "The meeting was moved to the morning. Everyone agreed that this was better for all of them, and nobody asked why."
    given = [(1, good), (1, good), (1, good + " Later a@b.cc wrote again."), (None, good + " Nobody knew."), (2, None), (None, ""), (3, "x " * 9000), (4, good.replace(" ", "  "))]
    data = [(k, t, None, None, None, *("z" for _ in extra)) for k, t in given] if kind == "odd" else []
    docs = spark.createDataFrame(data, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, SMALL, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, Scratch(spark, "odd").write(stage(spark, docs, str(tmp_path)), name)
        if name != "packing":
            assert docs.columns == before.columns and docs.count() <= before.count()
        if name == "pii":
            assert docs.count() == before.count() and not docs.where("text like '%a@b.cc%'").count()
        if kind == "empty":
            assert docs.count() == 0
    assert (docs.count() > 0) == (kind == "odd")


def test_exact_and_near_stages_keep_one_of_equal_rows(spark):
    text = " ".join(f"word{k}" for k in range(40))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text + " "), (None, "other"), (7, None), (7, "")], "doc_id long, text string")
    exact = corpus_pipeline.exact(spark, docs, SMALL)
    assert sorted((str(r.doc_id), r.text or "") for r in exact.collect()) == [("7", ""), ("None", "other"), ("None", text + " ")]
    near = corpus_pipeline.near(spark, docs, SMALL)
    assert sorted((str(r.doc_id), r.text or "") for r in near.collect()) == [("1", text), ("7", ""), ("7", ""), ("None", "other")]


@pytest.mark.parametrize("most_words", [1_000_000, 3, 1])
def test_kept_rows_by_bits(spark, tmp_path, most_words):
    """Rows of several files, read in one turn or in several; ids that aren't there are passed over."""
    made = spark.range(1000).select((F.col("id") * 7).alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit(None).cast("string").alias("lang"))
    made.repartition(5).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    wanted = [7 * k for k in range(0, 1000, 3)] + [1, 2, 10**9]
    ids = spark.createDataFrame([(k,) for k in wanted], "doc_id long")
    got = common.kept_rows(rows, ids, Scratch(spark, "t"), most_words=most_words)
    assert got.columns == rows.columns and sorted(r.doc_id for r in got.collect()) == wanted[:-3]
    assert common.kept_rows(rows, ids.limit(0), Scratch(spark, "t"), most_words=most_words).count() == 0


def test_texts_are_not_shuffled_to_be_kept(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text")).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    plan = common.kept_rows(rows, rows.where("doc_id % 2 = 0").select("doc_id"), Scratch(spark, "t"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
