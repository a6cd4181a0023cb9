"""Filter audit, source mix and vector codes against plain versions, on odd and planted rows."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction
from itertools import permutations

import pytest
from conftest import SMALL
from oracle import assert_same
from pyspark.sql import functions as F

from stratalode.llm import filter_audit, registry, source_mix, vector_codes

DOCS = "doc_id long, text string, source string, n string, mask string, part string, size string, target string, rate string, digest string"
random.seed(11)
WORDS = ["".join(random.choices("abcdefgh", k=random.randint(1, 6))) for _ in range(300)]


def texts():
    prose = [" ".join(random.choices(WORDS, k=n)) for n in (3, 60, 60, 80, 200, 20_000)]
    odd = [None, "", " \t\x0b", "#", "A" * 40, "Ab " * 60, "same word " * 40, prose[1] + " 5%", prose[2].upper(), "é\x1c\x85x " * 55, prose[1], prose[1]]
    return prose + odd


def rows():
    """Null ids, repeated ids with the same and other texts and sources, copies over sources, a hot source."""
    out = []
    for k, t in enumerate(texts() * 4):
        out.append((k, t, ["a", "a", "a", "b", None, "", "z"][k % 7]))
    out += [(None, "x y", "a"), (None, "x y", "b"), (None, texts()[1], "b"), (3, out[3][1], "b"), (3, out[3][1], "b"), (3, "other", None), (0, out[5][1], "z")]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 7) for r in rows], DOCS).repartition(5)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


LABELS = [(0, 1, 0), (1, 0, 1), (2, None, None), (3, 1, 1), (3, 0, 0), (4, 1, None), (9, 1, 1), (10, 1, 0), (None, 1, 1), (5000, 1, 1)]


def plain_audit(rows):
    good = {d for d, q, _ in LABELS if q == 1} - {None}
    toxic = {d for d, _, t in LABELS if t == 1} - {None}
    docs = []
    for doc, text, part in rows:
        ws, text = words(text), text or ""
        twins = [d for d, t, _ in rows if (t or "") == text and d is not None]
        fails = set()
        fails |= {"A"} if len(ws) < 50 else set()
        fails |= {"B"} if 100 * len(set(ws)) < 65 * len(ws) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else set()
        fails |= {"D"} if re.search("[#$%&*|]", text) else set()
        fails |= {"E"} if any(doc is None or d < doc for d in twins) else set()
        docs.append((part or "", fails, doc in good, doc in toxic))
    out, sums = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            for k, own in enumerate(order):
                failing = [d for d in docs if d[0] == part and own in d[1]]
                gone = [d for d in left if own in d[1]]
                left = [d for d in left if own not in d[1]]
                out[part, "".join(order), k + 1] = [len(left), len(gone), len(failing) - len(gone), sum(d[1] == {own} for d in failing), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                sums[part, own] += len(gone)
    return {k: (*v, sums[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_plain_version(spark):
    labels = spark.createDataFrame([(*r, "x") for r in LABELS], "doc_id long, quality int, toxic int, source string")
    got = filter_audit.filter_audit(frame(spark, rows()), labels).collect()
    want = plain_audit(rows())
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == want and len(got) == len(want)


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(frame(spark, []), labels).count() == 0
    one = filter_audit.filter_audit(frame(spark, [(1, None, None)]), labels).where("filter_order = 'ABCDE' and step = 1").collect()
    assert [tuple(r) for r in one] == [("", "ABCDE", 1, 0, 1, 0, 1, 0, 0, 120)]


def test_audit_of_a_hot_text(spark):
    """A third of the rows are one text; each source keeps what is its own."""
    n = 3000
    made = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("t "), F.col("id").cast("string"))).alias("text"), F.concat(F.lit("s"), F.col("id") % 2).alias("source"))
    got = filter_audit.filter_audit(made.repartition(8), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    got = {r.part: r.removed for r in got.where("filter_order = 'EABCD' and step = 1").collect()}
    assert got == {"s0": 500 - 1, "s1": 500}


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Reshare until no source is above; sizes: by source, in order."""
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sizes)}
    stopped: set = set()
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in stopped)
        free = sum(w for s, w in weight.items() if s not in stopped)
        target = {s: Fraction(most * sizes[s]) if s in stopped else Fraction(rest * weight[s], free) for s in sizes}
        above = {s for s in sizes if s not in stopped and target[s] > most * sizes[s]}
        if not above:
            return target
        stopped |= above


def by_source(rows):
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(words(text))
    return {s: sizes[s] for s in sorted(sizes, key=lambda s: (s is None, (s or "").encode()))}


@pytest.mark.parametrize("seed", range(6))
def test_targets_equal_plain_version(spark, seed):
    r = random.Random(seed)
    made = [(k, " ".join(["w"] * (0 if r.random() < 0.1 else int(10 ** r.uniform(0, 3)))), r.choice(["", "a", "b", "Z", "é", "😀", "￿", None])) for k in range(4 + 20 * seed)]
    sizes = by_source(made)
    got = {x.source: x for x in source_mix.source_rates(frame(spark, made)).collect()}
    want = plain_targets(sizes)
    assert list(got).__len__() == len(sizes) and all(got[s].source_size == n for s, n in sizes.items())
    assert all(got[s].target == pytest.approx(float(want[s]), rel=1e-12) for s in sizes)
    assert sum(x.target for x in got.values()) == pytest.approx(sum(sizes.values()))


def test_mix_emits_what_the_draws_say(spark):
    made = rows()
    rates = {s: t / n if (n := by_source(made)[s]) else 0 for s, t in plain_targets(by_source(made)).items()}
    want = Counter()
    for doc, text, source in made:
        u = int(hashlib.md5(f"mix:{'' if doc is None else doc}:{text or ''}".encode()).hexdigest()[:12], 16) / 2**48
        whole = math.floor(rates[source])
        want[doc, text, source] += whole + (u < rates[source] - whole)
    docs = frame(spark, made)
    mixed = source_mix.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter((r.doc_id, r.text, r.source) for r in mixed.collect()) == +want
    again = source_mix.mix(docs.repartition(3))
    assert Counter((r.doc_id, r.text, r.source) for r in again.collect()) == +want


def test_mix_comes_near_its_targets(spark):
    """A source with a third of all rows, one far below its share, one far above it."""
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 40).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "b").when(F.col("id") < 300, "a").otherwise("c").alias("source"))
    rates = {r.source: r for r in source_mix.source_rates(docs).collect()}
    assert rates["a"].rate == 3.0
    taken = {r.source: r.n for r in source_mix.mix(docs).groupBy("source").agg(F.sum(source_mix.words(F.col("text"))).alias("n")).collect()}
    assert all(taken[s] == pytest.approx(r.target, rel=0.05) for s, r in rates.items())


def test_mix_of_nothing(spark):
    assert source_mix.mix(frame(spark, [])).count() == 0
    assert source_mix.mix(frame(spark, [(1, None, "a"), (2, "", None), (None, " ", "b")])).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, code string, error string, pos string, part string"


def plain_codes(kept, entries, rounds):
    """kept: (vec_id, integers, label), in the order of their ids."""
    width = len(kept[0][1]) // 4
    cut = lambda v, p: v[p * width : (p + 1) * width]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    books = [[list(cut(v, p)) for _, v, _ in kept[:entries]] for p in range(4)]
    near = lambda p, x: min(range(len(books[p])), key=lambda k: (far(books[p][k], x), k))
    for _ in range(rounds):
        for p in range(4):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(p, cut(v, p)), []).append(cut(v, p))
            for k, g in groups.items():
                books[p][k] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    rows, sums = [], Counter()
    for vec, v, label in kept:
        codes = [near(p, cut(v, p)) for p in range(4)]
        error = sum(far(books[p][codes[p]], cut(v, p)) for p in range(4))
        rows.append((vec, label, "".join(f"{c:02x}" for c in codes), error))
        sums[label] += error
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((vec, code, error, sums[label], sha) for vec, label, code, error in rows), key=repr)


@pytest.mark.parametrize("entries, dim, values", [(7, 8, None), (256, 4, None), (5, 16, 3), (12, 12, 2)])
def test_codes_equal_plain_version(spark, entries, dim, values):
    r = random.Random(dim)
    number = (lambda: r.gauss(0, 1)) if values is None else (lambda: r.randrange(values) / 1024 - 0.001)  # few values: ties and shared parts
    made = [(k * 3 - 50, [float(F32(number())) for _ in range(dim)], [None, 1, 2, 1][k % 4]) for k in range(180)]
    made += [(9000 + k, made[4][1], 7) for k in range(90)]  # a third are one vector
    odd = [(9500, None, 1), (9501, [1.0, None] * (dim // 2), 1), (9502, [float("nan")] * dim, None), (9503, [float("inf")] + [0.0] * (dim - 1), 1), (9504, [-float("inf")] * dim, 2)]
    kept = [(k, [math.floor(1024 * x) for x in v], label) for k, v, label in sorted(made)]
    df = spark.createDataFrame([(*x, *["x"] * 4) for x in made + odd], VECTORS).repartition(4)
    got = vector_codes.vector_codes(df, entries=entries)
    assert sorted((tuple(x) for x in got.collect()), key=repr) == plain_codes(kept, entries, 4)


def F32(x):
    import numpy as np

    return np.float32(x)


def test_codes_of_odd_tables(spark):
    make = lambda rows: spark.createDataFrame([(*x, *["x"] * 4) for x in rows], VECTORS)
    assert vector_codes.vector_codes(make([])).count() == 0
    assert vector_codes.vector_codes(make([(1, None, 1)])).count() == 0
    # Other lengths have codebooks of their own; rows of one id and without one are vectors each.
    rows = [(1, [0.5] * 4, 1), (1, [0.5] * 4, 1), (None, [0.25] * 4, None), (None, [0.75] * 4, None), (5, [1.0] * 8, 1), (6, [], 2), (7, [0.1] * 5, 3)]
    got = sorted(((r.vec_id, r.code, r.error, r.label_error) for r in vector_codes.vector_codes(make(rows)).collect()), key=repr)
    assert got == sorted([(1, "00000000", 0, 0), (1, "00000000", 0, 0), (None, "02020202", 0, 0), (None, "03030303", 0, 0), (5, "00000000", 0, 0), (6, "00000000", 0, 0), (7, "01010101", 0, 0)], key=repr)
    big = vector_codes.vector_codes(make([(1, [3e38, -3e38, 0.0, 0.0], 1), (2, [0.0] * 4, 1)]), entries=1, rounds=0).collect()
    assert {r.vec_id: r.error for r in big} == {1: 0, 2: 2 * (1 << 52)}


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_filter_audit", "op13_source_mix"])
def test_queries_equal_sql(spark, name):
    assert_same(registry.queries()[name](spark, SMALL), registry.oracle_sql()[name], SMALL)
