"""Text search over units: documents, postings, exact, prefix and fuzzy tokens, BM25 ranks.

A unit's document holds its constants' values. An index is written once
(:func:`write_index`) and is these tables:

* ``postings`` (doc_id, token, tf, and its document's len), by document, and ``lengths`` (doc_id, len), ``stats``, one row;
* ``tokens`` (token, df), sorted: a beginning is a range of it;
* ``keys`` (key, cut, token): what is left of a token's first seven characters
  when at most two are deleted. Tokens within two edits of each other share a
  key, so a fuzzy lookup is an equi-join of few keys, verified by distance.
  Those of two deletions, three in four, stand apart: only two edits need them;
* ``blocks`` (token, window, n, max_tf, min_len, docs): a token's postings in a
  window of some 64 documents, with what bounds their scores.

Keys and blocks stand in folders by a hash, of which a lookup opens those it needs.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import Catalogue
from ..functions import text as T
from . import store

TOKEN = r"[\p{L}\p{N}_]+(?:[.'][\p{L}\p{N}_]+)*"
K1, B = 1.2, 0.75
LEAST_GRAM, MOST_GRAM = 2, 20
PREFIX, MOST_EDITS = 7, 2
BUCKETS, WINDOW_DOCS = 64, 64
FEW_ROWS = 200_000
TASK_DOCS, TASK_TOKENS, TASK_POSTINGS = 1_000, 20_000, 500_000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def edge_grams(token: Column) -> Column:
    """Beginnings of 2 to 20 characters of a token."""
    top = F.least(F.lit(MOST_GRAM), F.length(token))
    return F.when(top >= LEAST_GRAM, F.transform(F.sequence(F.lit(LEAST_GRAM), top), lambda n: F.substring(token, F.lit(1), n))).otherwise(F.array().cast("array<string>"))


def documents(cat: Catalogue, project: str | None = None) -> DataFrame:
    """(id, project, unit_name, unit_version, source_kind, constant_values, constant_pairs, semantic_pairs) of every unit; project: of its units, and only their constants are gathered."""
    units = cat.descriptors.withColumnRenamed("id", "descriptor_id").join(cat.snapshots.withColumnRenamed("id", "snapshot_id"), "descriptor_id")
    constants = cat.constants
    if project is not None:
        units = units.where(F.col("project") == project)
        constants = constants.join(units.select("snapshot_id"), "snapshot_id", "left_semi")
    rows = constants.withColumnRenamed("id", "constant_id").join(cat.usages, "constant_id")
    display = F.coalesce("semantic_display_name", "semantic_type_name")
    said = rows.groupBy("snapshot_id").agg(
        F.sort_array(F.collect_set("constant_value")).alias("constant_values"),
        F.sort_array(F.collect_set(T.usage_pair(F.col("constant_value"), F.col("structural_type")))).alias("constant_pairs"),
        F.sort_array(F.collect_list(F.when(display.isNotNull(), T.semantic_pair(F.col("constant_value"), display, F.col("confidence"))))).alias("semantic_pairs"),
    )
    return units.join(said, "snapshot_id").select(
        F.concat_ws(":", "project", "unit_name", "version").alias("id"), "project", "unit_name", F.col("version").alias("unit_version"), "source_kind", "constant_values", "constant_pairs", "semantic_pairs"
    )


def postings(docs: DataFrame, id_col: str, values: Column) -> DataFrame:
    """(doc_id, token, tf) of documents; values: array<string>."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.flatten(F.transform(values, tokens))).alias("token"))
    return rows.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("tf"))


@dataclass
class Index:
    """postings (doc_id, token, tf), tokens (token, df), lengths (doc_id, len); path: where it is written, with keys and blocks, or None."""

    postings: DataFrame
    tokens: DataFrame
    lengths: DataFrame
    path: str | None = None

    @classmethod
    def of(cls, posting: DataFrame) -> Index:
        """The index that postings make, not written."""
        return cls(posting, posting.groupBy("token").agg(F.count(F.lit(1)).alias("df")), posting.groupBy("doc_id").agg(F.sum("tf").alias("len")))

    @classmethod
    def at(cls, spark: SparkSession, path: str) -> Index:
        rows, *others = [spark.read.parquet(f"{path}/{name}") for name in ("postings", "tokens", "lengths")]
        return cls(rows.drop("len"), *others, path)

    def table(self, name: str) -> DataFrame:
        """A written index's table; keys and blocks that were left for later are written now."""
        if name == "keys":
            return self.keys(MOST_EDITS)
        if name == "blocks" and not store.exists(self.tokens.sparkSession, f"{self.path}/{name}/_SUCCESS"):
            write_blocks(self)
        return self.tokens.sparkSession.read.parquet(f"{self.path}/{name}")

    def keys(self, edits: int) -> DataFrame:
        """(key, token, cut, bucket) as far as lookups of so many edits need them; those that aren't there are written now."""
        spark, levels = self.tokens.sparkSession, [f"{self.path}/keys/level={n}" for n in range(1, max(1, edits) + 1)]
        for n, folder in enumerate(levels, 1):
            if not store.exists(spark, f"{folder}/_SUCCESS"):
                write_keys(self, n)
        rows = spark.read.schema("key string, cut int, token string, level int, bucket int").option("basePath", f"{self.path}/keys")
        return rows.parquet(*levels).drop("level")


TABLES = ("postings", "tokens", "lengths", "stats", "keys", "blocks")


def _bucket(text: Column) -> Column:
    return (F.crc32(F.encode(text, "UTF-8")) % BUCKETS).cast("int")


def _buckets(texts: list[str]) -> list[int]:
    return sorted({zlib.crc32(t.encode()) % BUCKETS for t in texts})


def deletion_keys(token: Column, level: int) -> Column:
    """array<struct<key, cut>>: the first characters of a token without none or one of them (level 1), or without two (level 2)."""
    start = F.substring(token, 1, PREFIX)

    def cuts(t: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.length(t)), lambda i: i > 0)
        return F.transform(places, lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.lit(PREFIX))))

    told = lambda keys, n: F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(n).alias("cut")))
    once = cuts(start)
    return F.array_distinct(F.concat(told(F.array(start), 0), told(once, 1)) if level == 1 else told(F.flatten(F.transform(once, cuts)), 2))


def _keys_of(asked: str, edits: int) -> set[str]:
    """The keys by which a query token finds those within so many edits."""
    keys = level = {asked[:PREFIX]}
    for _ in range(edits):
        level = {k[:i] + k[i + 1 :] for k in level for i in range(len(k))}
        keys = keys | level
    return keys


def _write(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("overwrite").partitionBy(*by).parquet(path)


def _spread(rows: DataFrame, each: int) -> Column:
    """How many slices a bucket is cut into, for so many rows of the source a slice."""
    return F.lit(1 + rows.count() // (BUCKETS * each))


def write_keys(index: Index, level: int) -> None:
    """Work goes by the number of tokens, not by the bytes of their files; each key is made once, so it isn't sampled for ranges."""
    tasks = max(index.tokens.sparkSession.sparkContext.defaultParallelism, index.tokens.count() // TASK_TOKENS)
    keys = index.tokens.select("token").repartition(tasks).select("token", F.inline(deletion_keys(F.col("token"), level))).withColumn("bucket", _bucket(F.col("key")))
    placed = keys.repartition("bucket", F.pmod(F.xxhash64("key"), _spread(index.tokens, TASK_TOKENS)))
    _write(placed.sortWithinPartitions("bucket", "key"), f"{index.path}/keys/level={level}", "bucket")


def write_blocks(index: Index) -> None:
    """Postings are shuffled once, by bucket and slice of the windows, and grouped where they are."""
    windows = index.table("stats").first()["windows"]
    rows = index.table("postings").where("doc_id is not null").withColumns({"window": F.pmod(F.xxhash64("doc_id"), F.lit(windows)), "bucket": _bucket(F.col("token"))})
    rows = rows.withColumn("slice", F.pmod(F.col("window"), _spread(index.postings, TASK_POSTINGS))).repartition("bucket", "slice")
    blocks = rows.groupBy("bucket", "slice", "token", "window").agg(
        F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"), F.sort_array(F.collect_list(F.struct("doc_id", "tf", "len"))).alias("docs")
    )
    _write(blocks.drop("slice").sortWithinPartitions("bucket", "token", "window"), f"{index.path}/blocks", "bucket")


def write_postings(docs: DataFrame, id_col: str, values: Column, path: str) -> None:
    """Texts are shuffled once, by document, and not their tokens; counts and lengths are made where a document is."""
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, docs.count() // TASK_DOCS)
    whole = docs.select(F.col(id_col).alias("doc_id"), values.alias("values")).repartition(tasks, "doc_id")
    own = Window.partitionBy("doc_id").orderBy("token").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    _write(postings(whole, "doc_id", F.col("values")).withColumn("len", F.sum("tf").over(own)), f"{path}/postings")


def write_index(docs: DataFrame, id_col: str, values: Column, path: str, later: bool = False) -> Index:
    """Writes the index of documents under a folder and opens it; later: keys and blocks when they are first asked for."""
    spark = docs.sparkSession
    write_postings(docs, id_col, values, path)
    made = Index.of(spark.read.parquet(f"{path}/postings"))
    _write(made.tokens.repartitionByRange("token").sortWithinPartitions("token"), f"{path}/tokens")
    _write(made.lengths, f"{path}/lengths")
    made = Index.at(spark, path)
    stats = made.lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    _write(stats.withColumn("windows", F.greatest(F.lit(1), F.ceil(F.col("n") / WINDOW_DOCS))).coalesce(1), f"{path}/stats")
    for name in ("keys", "blocks"):
        store.remove(spark, f"{path}/{name}")  # of an index that stood here before
        if not later:
            made.table(name)
    return made


def close(token: Column, asked: str, distance: int, transpositions: bool = False) -> Column:
    """Whether a token is within an edit distance of what is asked; with transpositions two neighbours that change places are one edit."""
    if distance == 0:
        return token == asked
    near = F.levenshtein(token, F.lit(asked), distance) >= 0
    if transpositions:
        swapped = [asked[:i] + asked[i + 1] + asked[i] + asked[i + 2 :] for i in range(len(asked) - 1)]
        for s in swapped:
            near = near | (token == s if distance == 1 else F.levenshtein(token, F.lit(s), distance - 1) >= 0)
    return near


def check_request(rows: int | None, fuzzy: int | None) -> tuple[int, int]:
    """(rows, fuzzy) as they count: rows from 1 to 100, 10 if not given; fuzzy 0, 1 or 2, 1 if not given."""
    fuzzy = 1 if fuzzy is None else fuzzy
    if fuzzy not in (0, 1, 2):
        raise ValueError("fuzzy must be 0, 1 or 2")
    return min(100, max(1, 10 if rows is None else rows)), fuzzy


def met_tokens(index: Index, asked: list[str], distance: int, transpositions: bool = False) -> DataFrame:
    """(token, q, exact, prefix): the index's tokens that a query's tokens meet, as words within the distance or as beginnings.

    In a written index beginnings are ranges of the sorted tokens, and words are
    found by their keys; in another one the distinct tokens are filtered.
    """
    asked = list(dict.fromkeys(asked))
    within = lambda q: close(F.col("token"), q, distance, transpositions)
    grams = [q for q in asked if LEAST_GRAM <= len(q) <= MOST_GRAM]
    spark = index.tokens.sparkSession
    none = spark.createDataFrame([], "token string, q string")
    begun = reduce(DataFrame.unionByName, [index.tokens.where(F.col("token").startswith(q)).select("token", F.lit(q).alias("q")) for q in grams], none)
    if index.path is None:
        words = reduce(DataFrame.unionByName, [index.tokens.where(within(q)).select("token", F.lit(q).alias("q")) for q in asked], none)
    else:
        pairs = {(q, k) for q in asked for k in _keys_of(q, distance)}
        if transpositions and distance:
            pairs |= {(q, k) for q in asked for i in range(len(q) - 1) for k in _keys_of(q[:i] + q[i + 1] + q[i] + q[i + 2 :], distance - 1)}
        keys = index.keys(distance).where(F.col("bucket").isin(_buckets([k for _, k in pairs])) & (F.col("cut") <= distance))
        wanted = spark.createDataFrame(sorted(pairs), "q string, key string")  # some 30 for each query token
        near = keys.join(F.broadcast(wanted), "key").select("token", "q").distinct()
        words = near.where(reduce(or_, [(F.col("q") == q) & within(q) for q in asked], F.lit(False)))
    both = words.withColumns({"exact": F.lit(True), "prefix": F.lit(False)}).unionByName(begun.withColumns({"exact": F.lit(False), "prefix": F.lit(True)}))
    return both.groupBy("token", "q").agg(F.max("exact").alias("exact"), F.max("prefix").alias("prefix"))


def matches(index: Index, asked: list[str], distance: int, transpositions: bool = False) -> DataFrame:
    """(doc_id, q, token, tf, exact, prefix) of the postings that a query's tokens meet."""
    return index.postings.join(met_tokens(index, asked, distance, transpositions), "token").select("doc_id", "token", "tf", "q", "exact", "prefix")


def _bm25(tf: Column, length: Column, df: Column, n: Column, avg_len: Column) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return F.coalesce(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_len)), F.lit(0.0))


def ranked(index: Index, asked: list[str], distance: int = 1, transpositions: bool = False) -> DataFrame:
    """(doc_id, score): for each query token the better of twice its BM25 as a word and its BM25 as a beginning, summed; 6 decimals."""
    lengths = index.lengths
    whole = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    found = matches(index, asked, distance, transpositions)
    per = found.groupBy("doc_id", "q").agg(F.sum(F.when(F.col("exact"), F.col("tf"))).alias("tf_w"), F.sum(F.when(F.col("prefix"), F.col("tf"))).alias("tf_p"))
    df = per.groupBy("q").agg(F.count("tf_w").alias("df_w"), F.count("tf_p").alias("df_p"))
    rows = per.join(F.broadcast(df), "q").join(lengths, "doc_id").crossJoin(F.broadcast(whole))  # a row a query token, and one row
    part = lambda tf, df_: _bm25(F.col(tf), F.col("len"), F.col(df_), F.col("n"), F.col("avg_len"))
    return rows.groupBy("doc_id").agg(F.round(F.sum(F.greatest(2 * part("tf_w", "df_w"), part("tf_p", "df_p"))), 6).alias("score"))


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.limit(FEW_ROWS + 1).count() <= FEW_ROWS else rows


def top_k(index: Index, asked: list[str], k: int = 10, distance: int = 1, transpositions: bool = False) -> tuple[DataFrame, dict[str, int]]:
    """(the k best of :func:`ranked`, what was read) of a written index, without scoring the rest.

    Each window's blocks bound the scores of its documents. The k windows of the
    highest bounds are scored; the score of the k-th document of those is one
    that the answer reaches, so of the other windows only those are scored whose
    bound isn't below it. read: postings that were met and those scored.
    """
    spark = index.tokens.sparkSession
    root = store.work_folder(spark, "top-k")

    def written(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{root}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{root}/{name}")

    kinds = F.filter(F.array(F.when(F.col("exact"), F.lit("w")), F.when(F.col("prefix"), F.lit("p"))), lambda x: x.isNotNull())
    met = written(met_tokens(index, asked, distance, transpositions).join(index.tokens, "token").select("token", "q", "df", F.posexplode(kinds).alias("nth", "kind")), "met")
    opened = [r[0] for r in met.select(_bucket(F.col("token"))).distinct().collect()]
    blocks = index.table("blocks").where(F.col("bucket").isin(opened)).join(_few(met.drop("df")), "token")
    # Documents that meet a query token: of one index token its df, of several the union of their blocks.
    n_df = {(r.q, r.kind): (r.tokens, r.df) for r in met.groupBy("q", "kind").agg(F.count(F.lit(1)).alias("tokens"), F.sum("df").alias("df")).collect()}  # two a query token
    several = [f"{kind}:{q}" for (q, kind), (tokens, _) in n_df.items() if tokens > 1]
    unions = blocks.where(F.concat_ws(":", "kind", "q").isin(several)).groupBy("q", "kind", "window").agg(F.size(F.array_distinct(F.flatten(F.collect_list(F.col("docs.doc_id"))))).alias("n"))
    n_df = {key: df for key, (_, df) in n_df.items()} | {(r.q, r.kind): r.n for r in unions.groupBy("q", "kind").agg(F.sum("n").alias("n")).collect()}
    n, avg_len, _ = index.table("stats").first()

    def best(tf_w: Column, tf_p: Column, length: Column) -> Column:
        """A query token's part of a score."""
        df = lambda kind: reduce(lambda other, q: F.when(F.col("q") == q, float(n_df.get((q, kind), 0))).otherwise(other), dict.fromkeys(asked), F.lit(0.0))
        return F.greatest(2 * _bm25(tf_w, length, df("w"), F.lit(n), F.lit(avg_len)), _bm25(tf_p, length, df("p"), F.lit(n), F.lit(avg_len)))

    of = lambda kind, c: F.sum(F.when(F.col("kind") == kind, F.col(c)))
    most = blocks.groupBy("window", "q").agg(of("w", "max_tf").alias("w"), of("p", "max_tf").alias("p"), F.min("min_len").alias("len"), F.sum(F.when(F.col("nth") == 0, F.col("n")).otherwise(0)).alias("postings"))
    bounds = most.groupBy("window").agg(F.sum(best(F.col("w"), F.col("p"), F.col("len"))).alias("bound"), F.sum("postings").alias("postings"))
    bounds = written(bounds, "bounds")

    def scored(windows: DataFrame) -> DataFrame:
        rows = blocks.join(_few(windows.select("window")), "window").select("q", "kind", F.inline("docs"))
        per = rows.groupBy("doc_id", "q").agg(of("w", "tf").alias("w"), of("p", "tf").alias("p"), F.min("len").alias("len"))
        return per.groupBy("doc_id").agg(F.round(F.sum(best(F.col("w"), F.col("p"), F.col("len"))), 6).alias("score"))

    order = [F.desc("score"), F.col("doc_id")]
    first = bounds.where(F.col("window").isin([r.window for r in bounds.orderBy(F.desc("bound"), "window").limit(k).collect()]))
    leading = written(scored(first).orderBy(*order).limit(k), "leading")
    lead, reached = leading.count(), leading.agg(F.min("score")).first()[0]
    rest = bounds.join(F.broadcast(first.select("window")), "window", "left_anti")  # k windows
    rest = rest.where(F.col("bound") >= (reached - 1e-5 if lead == k else -1.0))
    read = {"met": bounds.agg(F.sum("postings")).first()[0] or 0, "scored": first.unionByName(rest).agg(F.sum("postings")).first()[0] or 0}
    return leading.unionByName(scored(rest)).orderBy(*order).limit(k), read


def phrase_boost(docs: DataFrame, id_col: str, values: Column, asked: list[str], boost: float = 3.0) -> DataFrame:
    """(doc_id, boost) of documents one value of which holds the query's tokens in a row."""
    phrase = " ".join(asked)
    holds = F.exists(values, lambda v: F.concat(F.lit(" "), F.array_join(tokens(v), " "), F.lit(" ")).contains(f" {phrase} "))
    return docs.where(holds).select(F.col(id_col).alias("doc_id"), F.lit(boost).alias("boost"))


def search(
    docs: DataFrame, term: str, *, project: str | None = None, rows: int | None = None, fuzzy: int | None = None, transpositions: bool = False, index: Index | None = None
) -> DataFrame:
    """Best documents of a term, with ``total_found``; a null or blank project is all of them.

    index: one that is written, of docs; else it is made for this search. Ranks
    are over the documents of the project.
    """
    rows, distance = check_request(rows, fuzzy)
    scoped = bool(project and project.strip())
    if scoped:
        docs = docs.where(F.col("project") == project)
    asked = [t.lower() for t in term.split()]
    if index is None:
        index = Index.of(postings(docs, "id", F.col("constant_values")))
    elif scoped:
        ids = docs.select(F.col("id").alias("doc_id"))
        index = Index(index.postings.join(ids, "doc_id", "left_semi"), index.tokens, index.lengths.join(ids, "doc_id", "left_semi"))
    scored = ranked(index, asked, distance, transpositions)
    boost = phrase_boost(docs, "id", F.col("constant_values"), asked)
    scored = scored.join(boost, "doc_id", "left").select("doc_id", (F.col("score") + F.coalesce("boost", F.lit(0.0))).alias("score"))
    total = F.broadcast(scored.agg(F.count(F.lit(1)).alias("total_found")))
    best = scored.orderBy(F.desc("score"), "doc_id").limit(rows)
    back = docs.select(F.col("id").alias("doc_id"), "project", "unit_name", "unit_version", "source_kind", "constant_values", "semantic_pairs")
    return best.join(back, "doc_id").crossJoin(total).orderBy(F.desc("score"), "doc_id")


def indexed_unit(docs: DataFrame, key: str) -> DataFrame:
    """(value, usages) of one indexed document, from its pairs."""
    pairs = docs.where(F.col("id") == key).select(F.explode("constant_pairs").alias("pair"))
    parsed = pairs.select(T.pair_value(F.col("pair")).alias("value"), T.pair_usage(F.col("pair")).alias("usage")).where("value is not null")
    return parsed.groupBy("value").agg(F.sort_array(F.collect_set("usage")).alias("usages"))
