"""PII: information-theoretic sanitisation, in DataFrame operations only.

Base detectors find e-mail addresses, IP addresses, card and phone numbers by
pattern; the values they find are the protected entities. Which other terms
reveal an entity is estimated from the corpus: of the n(t) lines that say a term
t, n(t,e) stand with the entity e. What is known of p(e|t) is a lower bound of it
that holds in 95 of 100 cases (``z`` = 1.645: the score interval with continuity
correction), so a word met once beside an address tells nothing of it, however
rare the word. The disclosure takes off what the entity's own frequency gives:

    disclosure(t, e) = (bound(n(t,e), n(t)) - n(e) / N) / (1 - n(e) / N).

It is 0 where term and entity are independent and nears 1 where whoever reads
the term knows the entity: -log2 of it is what is left of the entity's
information. It doesn't move with the size of the corpus. In documents that
hold the entity, a term whose disclosure reaches ``generalise_at`` (one bit
left) is replaced by its class (number, code, name or word), one that reaches
``remove_at`` (a third of a bit) is removed. Lines of one entity that are equal
without it are one line, so copies don't add up to evidence.

Patterns are written with possessive repetitions and look-behind, which find
the same matches without backtracking, so a long run of digits or letters costs
time in proportion. Only found values, never texts, are shuffled; texts are
joined with what was found by broadcast where that is small, by a shuffle where
it isn't. Sums are combined before each shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, given_ids, own_rows, table

#: kind -> (what a text must hold, Java pattern); the order is the order of the result
KINDS = {
    "email": (r"@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"),
    "card": (r"[0-9](?:[ -]?[0-9]){15}", r"[0-9](?:[ -]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
}
TERM = "term"
_IP = rf"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]|[0-9]))(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]|[0-9])){{3}}$"
#: what a term is generalised to: pattern -> class, the first that fits
CLASSES = {r"^[\p{N}_'-]+$": "[NUMBER]", r"\p{N}": "[CODE]", r"^\p{Lu}": "[NAME]", "": "[WORD]"}
WORD = r"[\p{L}\p{N}][\p{L}\p{N}_'-]*+"
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32_000_000
MATCH = "array<struct<place:int,kind:string,i:int,value:string,gap:int,wanted:boolean>>"
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
TERM_SPAN = "array<struct<kind:string,start:int,end:int,value:string,disclosure:double>>"


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    back = F.reverse(digits)

    def add(total, i):
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(_IP)
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def located(texts: DataFrame, kinds: dict[str, tuple[str | None, str]], wanted=lambda m: F.lit(True)) -> DataFrame:
    """(doc_id, place, kind, start, end, value): all wanted matches of the kinds' patterns in texts (doc_id, text), in code points.

    The gaps between matches and the matches alternate, so a match ends after
    all gaps and matches up to it: a running sum along the document's matches,
    which costs time in proportion to them. place: the kind's number.
    """
    text = F.col("text")
    parts = []
    for place, (kind, (hint, pattern)) in enumerate(kinds.items()):
        found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), _numbered(place, kind, wanted))
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        both = F.zip_with(found, gaps, lambda m, g: m.withField("gap", g))  # one gap more than matches
        parts.append(F.when(text.rlike(hint), both).otherwise(F.array().cast(MATCH)) if hint else both)
    rows = texts.select("doc_id", F.explode(F.concat(*parts)).alias("m")).select("doc_id", "m.*").where("value is not null")
    along = Window.partitionBy("doc_id", "place").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(along).cast("int"))
    return rows.where("wanted").select("doc_id", "place", "kind", (F.col("end") - F.length("value")).alias("start"), "end", "value")


def _numbered(place: int, kind: str, wanted):
    return lambda m, i: F.struct(F.lit(place).alias("place"), F.lit(kind).alias("kind"), i.alias("i"), m.alias("value"), F.lit(0).alias("gap"), wanted(m).alias("wanted"))


def base_spans(texts: DataFrame) -> DataFrame:
    """(doc_id, spans) of the documents in which the base detectors find something, by kind, then start."""
    valid = F.lit(False)
    for kind in KINDS:
        valid = F.when(F.col("kind") == kind, _valid(kind, F.col("value"))).otherwise(valid)
    return _gathered(located(texts, KINDS).where(valid), "spans")


def _gathered(rows: DataFrame, as_: str) -> DataFrame:
    got = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("place", "start", "end", "kind", "value"))).alias("s"))
    return got.select("doc_id", F.transform("s", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"))).alias(as_))


def class_of(term: Column) -> Column:
    """The class that a term is generalised to."""
    out = F.lit(None).cast("string")
    for pattern, name in reversed(CLASSES.items()):
        out = F.when(term.rlike(pattern), name).otherwise(out)
    return out


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _few(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it has few rows and, as text, few bytes."""
    size = df.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.sum(F.length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(df) if size[0] <= BROADCAST_ROWS and (size[1] or 0) <= BROADCAST_BYTES else df


def _words(text: Column) -> Column:
    """The distinct words of a text, each in lower case; cut before that, as lower case may have more letters."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))


def least_share(k: Column, n: Column, z: float) -> Column:
    """Lower confidence bound of a share of which k of n were seen: Wilson's, with continuity correction."""
    p = k / n
    root = F.sqrt(F.greatest(z * z - 2 - 1 / n + 4 * p * (n * (1 - p) + 1), F.lit(0.0)))
    return F.greatest((2 * k + z * z - 1 - z * root) / (2 * (n + z * z)), F.lit(0.0))


def few_lines(z: float, at_least: float) -> int:
    """The smallest number of lines, all of which hold, whose bound is that high."""
    n, bound = 0, -1.0
    while bound < at_least:
        n += 1
        bound = max((2 * n + z * z - 1 - z * max(z * z + 2 - 1 / n, 0) ** 0.5) / (2 * (n + z * z)), 0.0)
    return n


CHUNK = 1024


def by_chunk(cuts: DataFrame, key: str) -> DataFrame:
    """(key, cuts): of (key, start, end, put) for each chunk of a text what is cut in it, as a map by the chunk's number."""
    first, last = (F.floor(c / CHUNK).cast("int") for c in (F.col("start"), F.greatest("start", F.col("end") - 1)))
    each = cuts.select(key, "start", "end", "put", F.explode(F.sequence(first, last)).alias("k"))
    at = F.col("k") * CHUNK
    own = F.struct(F.greatest(F.col("start") - at, F.lit(0)).cast("int").alias("start"), F.least(F.col("end") - at, F.lit(CHUNK)).cast("int").alias("end"), F.when(F.col("start") >= at, F.col("put")).otherwise("").alias("put"))
    lists = each.groupBy(key, "k").agg(F.sort_array(F.collect_list(own)).alias("own"))
    return lists.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("k", "own"))).alias("cuts"))


def cut_out(text: Column, cuts: Column) -> Column:
    """A text with its spans replaced; cuts as by_chunk gives them. Of spans that overlap each is put once, and what they cover goes.

    The text is cut into chunks in one pass and each chunk takes its own spans,
    so no place is counted from the text's beginning for each span.
    """

    def one(piece: Column, k: Column) -> Column:
        own = F.element_at(cuts, k)
        put = lambda done, s: F.struct(
            F.greatest(done["at"], s["end"]).alias("at"), F.concat(done["out"], F.substring(piece, done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0))), s["put"]).alias("out")
        )
        begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        return F.when(own.isNull(), piece).otherwise(F.aggregate(own, begin, put, lambda done: F.concat(done["out"], F.substring(piece, done["at"] + 1, F.lit(CHUNK)))))

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), one), "")


def _lines_of_entities(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(entities, line, rest) of each line with base spans of texts (doc_id, text), found (doc_id, spans); rest: the line without them.

    Spans are replaced by their numbers between two private characters, then the
    text is cut into lines; no span holds a line break.
    """
    each = found.select("doc_id", F.posexplode("spans").alias("i", "s"))
    cuts = by_chunk(each.select("doc_id", "s.start", "s.end", F.concat(F.lit("\uE000"), "i", F.lit("\uE001")).alias("put")), "doc_id")
    held = texts.join(_few(found.join(cuts, "doc_id")), "doc_id").withColumn("text", F.translate("text", "\uE000\uE001", "  "))
    lines = F.arrays_zip(F.split("text", "\n").alias("line"), F.split(cut_out(F.col("text"), F.col("cuts")), "\n").alias("marked"))
    rows = held.select("spans", F.explode(lines).alias("l")).select("spans", "l.line", "l.marked").where(F.col("marked").contains("\uE000"))
    of = F.transform(F.regexp_extract_all("marked", F.lit("\uE000([0-9]+)\uE001"), F.lit(1)), lambda i: F.element_at("spans", i.cast("int") + 1))
    entities = F.array_distinct(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["value"])))
    return rows.select(entities.alias("entities"), "line", F.regexp_replace("marked", "\uE000[0-9]+\uE001", " ").alias("rest"))


def disclosing_terms(texts: DataFrame, found: DataFrame, scratch: Scratch, *, least: int, z: float, generalise_at: float) -> DataFrame:
    """(entity, term, disclosure) of the terms that reveal an entity.

    texts: (doc_id, text); found: (doc_id, spans). The context of an entity is
    its whole line without the base spans; contexts that are equal count once,
    for the entity, the pair and the term. All counts are of lines: an entity or
    a term counts once in a line.
    """
    held = scratch.write(_lines_of_entities(texts, found), "held")
    # With fewer unlike contexts than few_lines no term of an entity can reach the threshold.
    digests = held.select(F.explode("entities").alias("entity"), F.md5("rest").alias("h")).groupBy("entity", "h").agg(F.count(F.lit(1)).alias("times"))
    said = digests.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).where(F.col("n_e") >= max(least, few_lines(z, generalise_at)))
    said = scratch.write(said, "said")
    contexts = held.select(F.explode("entities").alias("entity"), F.col("rest").alias("context")).join(_few(said.select("entity")), "entity")
    contexts = scratch.write(contexts.groupBy("entity", "context").agg(F.count(F.lit(1)).alias("times")), "contexts")
    joint = contexts.select("entity", "times", F.explode(_words(F.col("context"))).alias("term"))
    joint = joint.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_te"), (F.sum("times") - F.count(F.lit(1))).alias("copies")).where(F.col("n_te") >= least)
    joint = scratch.write(joint, "joint")
    terms = joint.select("term").distinct()
    lines = texts.select(F.explode(F.split(F.col("text"), "\n")).alias("line"))
    total = float(texts.agg(F.sum(F.size(F.split(F.col("text"), "\n"))).alias("n")).first()["n"] or 1)
    met = lines.select(F.explode(_words(F.col("line"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).join(_few(terms), "term")  # no semi-join: Spark would do that one before it counts
    inside = held.select(F.explode(F.array_except(_words(F.col("line")), _words(F.col("rest")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_in"))  # lines that hold a term in base spans only
    met = scratch.write(met.join(_few(inside), "term", "left").select("term", (F.col("n_t") - F.coalesce("n_in", F.lit(0))).alias("n_t")), "met")
    rows = joint.join(_few(met), "term").join(_few(said), "entity")
    bound = least_share(F.col("n_te"), F.greatest(F.col("n_t") - F.col("copies"), F.col("n_te")), z)
    base = F.least(F.col("n_e") / total, F.lit(1.0))
    told = F.when(base < 1, F.greatest((bound - base) / (1 - base), F.lit(0.0))).otherwise(0.0)
    scored = rows.select("entity", "term", told.alias("disclosure"))
    return scratch.write(scored.where(F.col("disclosure") >= generalise_at), "terms")


def _outside(words: DataFrame, base: DataFrame) -> DataFrame:
    """words (doc_id, start, end, ...) that overlap no base span (doc_id, start, end)."""
    rows = words.withColumn("base", F.lit(False)).unionByName(base.select("doc_id", "start", "end").withColumn("base", F.lit(True)), allowMissingColumns=True)
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    before = F.max(F.when(F.col("base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    clear = (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end"))
    return rows.withColumns({"before": before, "after": after}).where(~F.col("base") & clear).select(*words.columns)


def find_pii(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    least: int = 1,
    z: float = 1.645,
    generalise_at: float = 0.5,
    scratch: Scratch | None = None,
) -> tuple[DataFrame, DataFrame]:
    """((doc_id, base, terms) of the documents with spans, the terms' table).

    base is an array of (kind, start, end, value), terms one of (kind, start,
    end, value, disclosure); terms' value is the term and their kind ``term``.
    """
    spark: SparkSession = docs.sparkSession
    scratch = scratch or Scratch(spark, "pii")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = scratch.write(base_spans(texts), "found")
    terms = disclosing_terms(texts, found, scratch, least=least, z=z, generalise_at=generalise_at)
    base = found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")
    entities = base.select("doc_id", F.concat_ws(":", "kind", "value").alias("entity")).distinct()
    entities = scratch.write(entities.join(_few(terms.select("entity").distinct()), "entity"), "entities")
    # Words of the documents whose entities have terms, then those that are terms, then those of an entity of their document.
    words = located(texts.join(_few(entities.select("doc_id").distinct()), "doc_id"), {TERM: (None, WORD)})
    words = words.withColumn("term", F.lower("value")).join(_few(terms), "term").join(_few(entities), ["doc_id", "entity"])
    words = words.groupBy("doc_id", "start", "end", "kind", "value").agg(F.max("disclosure").alias("disclosure"))
    clear = _outside(words, base.join(_few(entities.select("doc_id").distinct()), "doc_id", "left_semi"))
    kept = clear.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind", "value", "disclosure"))).alias("t"))
    kept = kept.select("doc_id", F.transform("t", lambda x: F.struct(*[x[c].alias(c) for c in ("kind", "start", "end", "value", "disclosure")])).alias("terms"))
    joined = found.join(kept, "doc_id", "left").select("doc_id", F.col("spans").alias("base"), F.coalesce("terms", F.array().cast(TERM_SPAN)).alias("terms"))
    return scratch.write(joined, "spans"), terms


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term) of each row.

    Null and empty texts have no spans. Rows of one id are documents of their
    own, and so are rows without one. Other columns are ignored.
    """
    scratch = options.pop("scratch", None) or Scratch(docs.sparkSession, "pii")
    docs, names = own_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), scratch)
    found, _ = find_pii(docs, scratch=scratch, **options)
    none = F.array().cast(SPAN)
    rows = docs.select("doc_id").join(found, "doc_id", "left")
    plain = F.transform("terms", lambda t: F.struct(*[t[c].alias(c) for c in ("kind", "start", "end", "value")]))
    rows = rows.select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce(plain, none).alias("terms"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    out = rows.select(
        "doc_id",
        *[count(kind) for kind in KINDS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", "terms")).alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
    )
    return given_ids(out, names, "doc_id")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, remove_at: float = 0.8, **options) -> DataFrame:
    """docs with ``text_col`` sanitised; all other columns and rows as they are.

    Base spans become ``[KIND]``; a term becomes its class, see CLASSES, or
    nothing from remove_at on. Spans that overlap go together and become what
    the first of them does. Documents without spans keep their text byte for
    byte; null stays null. Rows of one id are documents of their own, and so are
    rows without one.
    """
    scratch = options.pop("scratch", None) or Scratch(docs.sparkSession, "pii")
    docs, names = own_rows(docs, scratch, id_col)
    found, _ = find_pii(docs, id_col, text_col, scratch=scratch, **options)
    key = "__pii_doc"
    base = found.select(F.col("doc_id").alias(key), F.explode("base").alias("s")).select(key, "s.start", "s.end", F.concat(F.lit("["), F.upper("s.kind"), F.lit("]")).alias("put"))
    terms = found.select(F.col("doc_id").alias(key), F.explode("terms").alias("s"))
    terms = terms.select(key, "s.start", "s.end", F.when(F.col("s.disclosure") >= remove_at, "").otherwise(class_of(F.col("s.value"))).alias("put"))
    order = Window.partitionBy(key).orderBy("start", F.desc("end"))
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = base.union(terms).withColumn("first", F.when(F.coalesce(reached, F.lit(0)) <= F.col("start"), 1).otherwise(0))
    spans = spans.withColumn("group", F.sum("first").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = spans.groupBy(key, "group").agg(F.min_by("put", F.struct("start", -F.col("end"))).alias("put"), F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = scratch.write(by_chunk(spans, key).withColumnRenamed("cuts", "__pii_cuts"), "cuts")
    joined = docs.withColumn(key, F.col(id_col).cast("long")).join(_few(cuts), key, "left")
    text = F.when(F.col("__pii_cuts").isNull(), F.col(text_col)).otherwise(cut_out(F.col(text_col).cast("string"), F.col("__pii_cuts")))
    return given_ids(joined.withColumn(text_col, text).select(*docs.columns), names, id_col)


def op7_pii_sanitisation(spark, sf_dir):
    return pii_spans(table(spark, sf_dir, "documents"))
