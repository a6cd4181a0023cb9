"""search() against a plain version: ids, ranks, scores, phrase boost, fuzzy and prefix hits, total_found and the row limit."""

import math
import random
import re
from collections import Counter

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from stratalode.catalog import Catalogue
from stratalode.operators import search
from stratalode.plans.registry import QUERIES, P

TOKEN = re.compile(r"\w+(?:[.']\w+)*")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(docs, term, rows, distance):
    """(doc_id, score, total_found) of the best; docs: {id: values}."""
    counts = {k: Counter(t for v in values for t in TOKEN.findall(v.lower())) for k, values in docs.items()}
    counts = {k: c for k, c in counts.items() if c}
    mean = sum(sum(c.values()) for c in counts.values()) / len(counts)
    asked, scores = term.lower().split(), Counter()
    for q in dict.fromkeys(asked):
        per = {}
        for weight, meets in ((2, lambda t: edits(t, q) <= distance), (1, lambda t: t.startswith(q) and 2 <= len(q) <= 20)):  # noqa: B023
            tf = {k: sum(n for t, n in c.items() if meets(t)) for k, c in counts.items()}
            df = sum(n > 0 for n in tf.values())
            for k, n in tf.items():
                if n:
                    idf = math.log(1 + (len(counts) - df + 0.5) / (df + 0.5))
                    size = 1.2 * (0.25 + 0.75 * sum(counts[k].values()) / mean)
                    per[k] = max(per.get(k, 0), weight * idf * n * 2.2 / (n + size))
        scores.update(per)
    for k in scores:
        if any(f" {' '.join(asked)} " in f" {' '.join(TOKEN.findall(v.lower()))} " for v in docs[k]):
            scores[k] += 3
    best = sorted(scores.items(), key=lambda s: (-round(s[1], 6), s[0]))[:rows]
    return [(k, round(v, 4), len(scores)) for k, v in best]


def compare(got, want):
    assert [(r[0], r[2]) for r in got] == [(r[0], r[2]) for r in want]
    assert [r[1] for r in got] == pytest.approx([r[1] for r in want], abs=2e-4)


@pytest.mark.parametrize(("term", "rows", "fuzzy"), [("alpha beta", 5, 1), ("alpha beta", 100, 0), ("bet", 7, 2), ("beta alpha", 10, None)])
def test_search(spark, term, rows, fuzzy):
    rng = random.Random(2)
    words = ["alpha", "beta", "alphas", "betamax", "bets", "gamma", "alpah", "delta", "omega"]
    docs = {f"p:u{k:02}:1": [" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(rng.randint(1, 4))] for k in range(40)}
    made = [(k, "p", k, 1, "s", v, []) for k, v in docs.items()] + [("q:u:1", "q", "u", 1, "s", ["alpha beta"], [])]
    df = spark.createDataFrame(made, "id string, project string, unit_name string, unit_version int, source_kind string, constant_values array<string>, semantic_pairs array<string>")
    got = search.search(df, term, project="p", rows=rows, fuzzy=fuzzy).select("doc_id", "score", "total_found").collect()
    compare(got, plain(docs, term, rows, 1 if fuzzy is None else fuzzy))


def test_search_hits_of_the_catalogue(spark):
    cat = Catalogue.over(spark, SMALL)
    term = min(r.constant_value for r in cat.constants.select("constant_value").distinct().collect())
    docs = {r.id: r.constant_values for r in search.documents(cat).where(f"project = '{P}'").collect()}
    got = QUERIES["R06_R09_search_hits"](spark, SMALL).collect()
    assert got
    compare(got, plain(docs, term, 10, 1))


def index_of(spark, path, docs):
    from pyspark.sql import functions as F

    return search.write_index(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", F.array("text"), str(path))


def test_keys_find_all_tokens_within_the_distance(spark, tmp_path):
    rng = random.Random(4)
    words = {"".join(rng.choices("abcé", k=rng.randint(1, 12))) for _ in range(700)} | {"x" * 5000, "the", "hte", "teh", "abcdefghij", "abcdefghji"}
    index = index_of(spark, tmp_path, [(0, " ".join(sorted(words)))])
    asked = ["the", "abc", "a", "caébacbaabc", "abcdefghij", "bbbbbbbbbb"]
    for distance in (0, 1, 2):
        got = {(r.token, r.q) for r in search.met_tokens(index, asked, distance).where("exact").collect()}
        assert got == {(w, q) for w in words for q in asked if abs(len(w) - len(q)) < 3 and edits(w, q) <= distance}
    swapped = {(r.token, r.q) for r in search.met_tokens(index, ["the", "abcdefghij"], 1, True).where("exact").collect()}
    assert {("hte", "the"), ("teh", "the"), ("abcdefghji", "abcdefghij")} <= swapped
    begun = {(r.token, r.q) for r in search.met_tokens(index, asked, 1).where("prefix").collect()}
    assert begun == {(w, q) for w in words for q in asked if w.startswith(q) and len(q) > 1}


def test_fuzzy_words_open_folders_of_keys_and_no_list_of_tokens(spark, tmp_path):
    index = index_of(spark, tmp_path, [(k, f"word{k} other{k}") for k in range(500)])
    asked = "x" * 30  # too long for a beginning
    plan = search.met_tokens(index, [asked], 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert len(search._buckets(search._keys_of(asked, 1))) <= 8 < search.BUCKETS


@pytest.mark.parametrize(("asked", "distance"), [(["alpha"], 0), (["alpha", "be"], 1), (["rare"], 0), (["nothing"], 0), (["rare", "alpha", "gam"], 2)])
def test_top_k_equals_the_whole_ranking(spark, tmp_path, asked, distance):
    rng = random.Random(9)
    words = ["alpha", "beta", "bets", "gamma", "alpah", "delta"]
    docs = [(k, " ".join(rng.choices(words, k=rng.randint(0, 60)) + ["rare"] * (k % 97 == 0) * rng.randint(1, 9))) for k in range(1500)]
    index = index_of(spark, tmp_path, docs)
    got, read = search.top_k(index, asked, 10, distance)
    want = sorted(((-r.score, r.doc_id) for r in search.ranked(index, asked, distance).collect()))[:10]
    assert [(-r.score, r.doc_id) for r in got.collect()] == want
    assert read["scored"] <= read["met"]


def test_top_k_leaves_windows_out(spark, tmp_path):
    """Few documents say a word often: the others' windows aren't scored."""
    docs = [(k, "filler " * 50 + ("needle " * 40 if k in (5, 700, 1999) else "needle")) for k in range(2000)]
    index = index_of(spark, tmp_path, docs)
    got, read = search.top_k(index, ["needle"], 3, 0)
    assert {r.doc_id for r in got.collect()} == {5, 700, 1999}
    assert read["met"] == 2000 and read["scored"] < 400


def test_keys_and_blocks_are_written_when_they_are_asked_for(spark, tmp_path):
    """postings and tokens need neither; both come out as if written at once."""
    docs = spark.createDataFrame([(n, f"apple{n % 7} the tree{n} {'the ' * (n % 3)}") for n in range(300)], "doc_id long, text string")
    whole = search.write_index(docs, "doc_id", F.array("text"), str(tmp_path / "whole"))
    index = search.write_index(docs, "doc_id", F.array("text"), str(tmp_path / "later"), later=True)
    assert not (tmp_path / "later/keys").exists() and not (tmp_path / "later/blocks").exists()
    want = sorted(map(tuple, search.ranked(whole, ["the", "aple3"], 2).collect()))
    assert sorted(map(tuple, search.ranked(index, ["the", "aple3"], 2).collect())) == want
    assert (tmp_path / "later/keys").exists() and not (tmp_path / "later/blocks").exists()
    best = sorted(want, key=lambda r: (-r[1], r[0]))[:10]
    assert [tuple(r) for r in search.top_k(index, ["the", "aple3"], 10, 2)[0].collect()] == best
    for name in search.TABLES:
        assert sorted(map(repr, whole.table(name).collect())) == sorted(map(repr, index.table(name).collect()))


def test_an_index_shuffles_texts_and_not_tokens(spark, tmp_path):
    """postings are made where a document is; keys of two deletions and blocks' lengths cost nothing where they aren't needed."""
    docs = spark.createDataFrame([(n // 2, f"apple{n % 7} the tree{n} {'the ' * (n % 3)}") for n in range(300)] + [(None, "the"), (7, None)], "doc_id long, text string")
    made = search.postings(docs, "doc_id", F.array("text"))
    index = search.write_index(docs, "doc_id", F.array("text"), str(tmp_path / "index"), later=True)
    rows = index.table("postings")
    assert sorted(map(repr, index.postings.collect())) == sorted(map(repr, made.collect()))  # rows of one id are one document
    assert {r["len"] for r in rows.where("doc_id = 3").collect()} == {r["len"] for r in index.lengths.where("doc_id = 3").collect()} != set()
    search.met_tokens(index, ["the", "aple3"], 1).collect()
    assert [p.name for p in sorted((tmp_path / "index/keys").iterdir()) if p.is_dir()] == ["level=1"]
    assert {r.token for r in search.met_tokens(index, ["aple3"], 2).where("exact").collect()} == {f"apple{k}" for k in range(7)}
    assert [p.name for p in sorted((tmp_path / "index/keys").iterdir()) if p.is_dir()] == ["level=1", "level=2"]
    search.write_blocks(index)
    blocks = index.table("blocks").select(F.inline("docs"))
    assert sorted(map(tuple, blocks.collect())) == sorted((r.doc_id, r.tf, r["len"]) for r in rows.where("doc_id is not null").collect())


def test_postings_need_one_shuffle(spark, tmp_path, monkeypatch):
    """what is written as postings has one exchange, of whole texts."""
    plans = []
    monkeypatch.setattr(search, "_write", lambda rows, path, *by: plans.append(rows._jdf.queryExecution().executedPlan().toString()))
    docs = spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string")
    search.write_postings(docs, "doc_id", F.array("text"), str(tmp_path / "x"))
    assert plans[0].count("Exchange") == 1
