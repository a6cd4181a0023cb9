"""Queries that show commits of several writers, functions and rules that users bring, and guarded stages."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import given
from ..operators import commits, guarded, store
from .registry import table_query


@table_query("S13_S14_A11_commits", "events", "SELECT user_id, count(*) AS n, max(event_id) AS latest FROM events GROUP BY user_id")
def interleaved_writers(events):
    """Three loads of counts by user: two of them begin on the same version, so one is done anew; none is lost."""
    table = commits.Committed(events.sparkSession, store.work_folder(events.sparkSession, "committed"), "user_id long, n long, latest long", ["user_id"], 8)

    def load(third):
        return events.where(F.col("event_id") % 3 == third).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("latest"))

    def add(old, new):
        return old.unionByName(new).groupBy("user_id").agg(F.sum("n").alias("n"), F.max("latest").alias("latest"))

    table.write(load(0), add)
    slow = table.prepare(load(1), add)
    table.write(load(2), add)
    try:
        table.commit(slow)
    except commits.Conflict:
        table.write(load(1), add)
    return table.read()


@table_query("X02_table_function", "events", "SELECT event_id, k.key AS name, json_extract_string(props, '$.'||k.key) AS value FROM events, unnest(json_keys(props)) k(key)")
def table_function(events):
    """A user's extractor over a column, in a LATERAL join."""
    given.register_extractor(events.sparkSession, "json_pairs", lambda text: [(k, str(v)) for k, v in json.loads(text).items()], "name string, value string")
    rows = given.extracted(events.select("event_id", "props"), "json_pairs", "props")
    return rows.where("error is null").select("event_id", "name", "value")


@table_query("X03_splitter", "pages", r"SELECT page_id, part FROM (SELECT DISTINCT page_id, unnest(string_split(regexp_replace(url, '^[a-z]+://', ''), '/')) AS part FROM pages) WHERE part<>''")
def splitter(pages):
    """A user's splitter of a text into a set of parts."""
    given.register_extractor(pages.sparkSession, "url_parts", lambda url: [(p,) for p in sorted(set(url.split("://")[-1].split("/")) - {""})], "part string")
    return given.extracted(pages.select("page_id", "url"), "url_parts", "url").select("page_id", "part")


RULES = "SELECT string_split(p_name,' ')[1] AS word, 'COLOUR' AS semantic, 0.5+(min(p_partkey)%40)/100.0 AS confidence FROM part GROUP BY ALL UNION ALL SELECT string_split(p_name,' ')[2], 'KIND', 0.6 FROM part WHERE p_size%2=0 GROUP BY ALL"


@table_query(
    "X01_rules_of_a_table",
    "part",
    f"WITH rules AS ({RULES} UNION ALL SELECT 'gear', 'GEARS', 0.99), v AS (SELECT DISTINCT p_name FROM part), m AS (SELECT p_name, semantic, confidence, row_number() OVER (PARTITION BY p_name ORDER BY confidence DESC, word, semantic) AS k FROM v JOIN rules ON list_contains(string_split(p_name,' '), word)) SELECT v.p_name, semantic, confidence::DOUBLE AS confidence FROM v LEFT JOIN m ON m.p_name=v.p_name AND k=1",
)
def rules_of_a_table(part):
    """Values classified by the rules of a table, one of them added while it runs."""
    spark, path = part.sparkSession, store.work_folder(part.sparkSession, "rules")
    word = lambda k: F.element_at(F.split("p_name", " "), k)
    colours = part.groupBy(word(1).alias("word"), F.lit("COLOUR").alias("semantic")).agg((0.5 + (F.min("p_partkey") % 40) / 100).alias("confidence"))
    kinds = part.where("p_size % 2 = 0").select(word(2).alias("word"), F.lit("KIND").alias("semantic"), F.lit(0.6).alias("confidence")).distinct()
    colours.unionByName(kinds).write.parquet(path)
    before = given.by_rules(part, "p_name", spark.read.parquet(path))
    before.where("semantic = 'GEARS'").count()  # none yet
    spark.createDataFrame([("gear", "GEARS", 0.99)], "word string, semantic string, confidence double").write.mode("append").parquet(path)
    return given.by_rules(part, "p_name", spark.read.parquet(path))


CHECKED = "CASE WHEN text IS NULL OR trim(text)='' THEN 'empty text' WHEN length(text)<>n_chars THEN 'n_chars is not the length' WHEN doc_id%97=0 THEN 'planted' END"


@table_query("X04_T07_guarded_stage", "documents", f"WITH c AS (SELECT {CHECKED} AS error FROM documents), n AS (SELECT count(*) AS n FROM c) SELECT coalesce(error,'') AS error, count(*) AS rows, any_value(n.n)//100 AS ticks FROM c, n GROUP BY 1")
def guarded_stage(documents):
    """Documents through a checked stage with planted failures: outcomes as written, ticks as observed, one pass."""
    spark, path = documents.sparkSession, store.work_folder(documents.sparkSession, "guarded")
    error = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty text").when(F.length("text") != F.col("n_chars"), "n_chars is not the length").when(F.col("doc_id") % 97 == 0, "planted")
    told = guarded.run(guarded.guarded(documents.select("doc_id", "text", "n_chars"), error), path, budget=1.0, every=100, name="documents")
    rows = spark.read.parquet(path)
    return rows.groupBy(F.coalesce("error", F.lit("")).alias("error")).agg(F.count(F.lit(1)).alias("rows"), F.lit(told["ticks"]).cast("long").alias("ticks"))
