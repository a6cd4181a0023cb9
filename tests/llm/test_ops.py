"""The corpus operators against the vocabularies' library, plain versions and SQL, on odd and planted inputs."""

import hashlib
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import brute
from conftest import SMALL
from oracle import assert_same

from stratalode.llm import bpe, bpe_codec, embedding_dedup, exact_dedup, jaccard_join, packing, pii, quality_crf, quote_links, registry, substring_dedup, token_counts
from stratalode.llm.common import Scratch, components, table

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
random.seed(5)
VOCABULARY = ["".join(random.choices("abcdefghij", k=random.randint(1, 7))) for _ in range(400)]


def prose(n):
    return " ".join(random.choices(VOCABULARY, k=n))


def edited(text, rate):
    return " ".join(random.choice(VOCABULARY) if random.random() < rate else w for w in text.split(" "))


def corpus():
    base, passage = prose(120), prose(60)
    texts = [None, "", " \t\n", "one", "One two three", "one two three", prose(40), base, base, base.replace(" ", "  \n"), base.upper(), passage]
    texts += [edited(base, 0.01) for _ in range(40)]  # near copies of one text
    texts += [prose(30) + "\n" + passage + " " + prose(30) for _ in range(30)]  # a passage that many share
    texts += ["as " * 400, "as " * 401, prose(6000), "x" * 30_000, "héllo wörld <|endoftext|> 😀 it's we'll   end ", "a\x0bb\x1cc\x85d"]
    texts += [prose(25) for _ in range(30)]
    return list(enumerate(texts))


DOCS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "s", len(t or "")) for k, t in DOCS]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def clashing(docs):
    """The same with columns named like the operators' own."""
    names = ["n", "h", "sha", "prefix", "part", "class", "component", "spans", "base", "told", "words", "score", "ids", "label", "norm", "keep_id", "kept", "n_norm", "term", "entity"]
    return docs.withColumns({c: F.lit("x") for c in names})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("method", ["merge", "prefix"])
def test_bpe_equals_the_library(library, method):
    parts = ["a", "b", "s", " ", "  ", "\n", "'", "'s", "'re", "'ll", "1", "é", "!", "\t", " ", "<|endoftext|>", "😀", "́", "\r\n", " '", "'ve", "\x1c", "\x85", "ing", " the"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 40))) for _ in range(1500)] + ["", "a" * 3000, "ab" * 999, " " * 300 + "x"]
    ids, n = bpe.encode(texts, PATH, method)
    stop = np.cumsum(n)
    for t, s, e in zip(texts, stop - n, stop, strict=True):
        assert library(t) == ids[s:e].tolist(), t
    assert bpe.count(texts, PATH, method).tolist() == n.tolist()


def test_pre_tokens_equal_the_library_for_all_code_points():
    from tokenizers.pre_tokenizers import ByteLevel

    from stratalode.llm import textscan

    cut = ByteLevel(add_prefix_space=False).pre_tokenize_str
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(chars), 5000):
        text = "".join(f"a{c}1{c}{c} {c}" for c in chars[i : i + 5000])
        p = textscan.pretokens([text])
        assert [b for _, b in cut(text)] == list(zip(p.starts.tolist(), p.ends.tolist(), strict=True))


def test_memo_forgets_beyond_its_bound(library):
    m = bpe.Memo(bpe.RankMerger(bpe.load(PATH)).encode, bound=50)
    from stratalode.llm import textscan

    for _ in range(5):
        text = prose(200)
        pieces = textscan.pretokens([text])
        at, size, ids = m.look_up(pieces)
        assert [i for a, n in zip(at, size, strict=True) for i in ids[a : a + n].tolist()] == library(text)


def test_token_counts(clashing, library):
    got = {r.doc_id: tuple(r)[1:] for r in token_counts.token_counts(clashing).collect()}
    assert got == {k: (len((t or "").encode()), len(library(t)), len(library(t)) > 1024) for k, t in DOCS}


def test_codec(clashing, library):
    got = {r.doc_id: tuple(r)[1:] for r in bpe_codec.round_trip(clashing).collect()}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {k: (len(library(t)), digest(np.array(library(t), "<u4").tobytes()), digest((t or "").encode())) for k, t in DOCS}
    back = bpe_codec.decode(bpe_codec.encode(clashing)).collect()
    assert {r.doc_id: r.text for r in back} == {k: t or "" for k, t in DOCS}


@pytest.mark.parametrize("buffer", [1_000_000, 5_000])
def test_packing(clashing, library, buffer):
    rows = packing.pack(clashing, buffer_tokens=buffer).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for k, t in DOCS:
        ids, at = [*library(t), 1], 0
        for r in sorted(by_doc[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0
    steps, tiers = {}, set()
    for pieces in by_sequence.values():
        first = pieces[0]
        steps[first.step_group] = steps.get(first.step_group, 0) + first.sequence_tokens
        tiers.add(first.tier)
        assert first.sequence_tokens in (first.tier, 0) and sum(r.length for r in pieces) == first.sequence_tokens
    assert max(steps.values()) <= 65_536 and {256, 512, 2048} <= tiers


TIERS = (256, 512, 1024, 2048)


def test_pack_lengths_holds_each_token_once():
    for _ in range(50):
        lengths = [random.choice([1, 5, 100, 300, 900, 2047, 2048, 2049, 9000]) for _ in range(random.randint(0, 30))]
        seen = [set() for _ in lengths]
        for tier, s in packing.pack_lengths(lengths, 2048, TIERS):
            used = sum(n for _, _, n in s)
            assert used <= 2048 and used & (used - 1) == 0 and tier in (0, used)
            for item, start, n in s:
                span = set(range(start, start + n))
                assert not seen[item] & span
                seen[item] |= span
        assert [len(x) for x in seen] == lengths


def test_tiers_are_packed_and_gaps_filled_from_shorter_ones():
    """Each tier gets sequences of its own size; a long one's gap holds the longest that fits; few documents are cut."""
    lengths = [1500] * 20 + [700] * 40 + [300] * 140 + [100] * 400
    got = packing.pack_lengths(lengths, 2048, TIERS)
    by = {t: [s for tier, s in got if tier == t] for t in TIERS}
    assert all(by.values()) and len(by[2048]) == 20 and all(lengths[s[0][0]] == 1500 for s in by[2048])
    assert all(lengths[s[0][0]] == 700 for s in by[1024][:5])
    assert any(lengths[item] == 300 for s in by[2048] for item, _, _ in s[1:])
    assert sum(len(s) for _, s in got) < 1.5 * len(lengths)


def test_step_groups_are_balanced():
    used = [2048] * 300 + [1024] * 111 + [512] * 77 + [256] * 53
    random.shuffle(used)
    group = packing.deal(used, 65_536)
    total, share = {}, {}
    for u, g in zip(used, group, strict=True):
        total[g] = total.get(g, 0) + u
        share[g, u] = share.get((g, u), 0) + 1
    assert len(total) == -(-sum(used) // 65_536) and max(total.values()) - min(total.values()) <= 256 and max(total.values()) <= 65_536
    assert max(share[g, 2048] for g in total) - min(share[g, 2048] for g in total) <= 1


@pytest.mark.parametrize("options", [{}, {"bucket_capacity": 3}, {"held_bytes": 500}, {"key_of": lambda norm: len(norm) % 5 - 2, "bucket_capacity": 3}])
def test_exact_dedup(clashing, options):
    """Any hash will do: records of one hash are chained and compared."""
    got = {r.doc_id: (r.keep_id, r.group_size, r.text_sha256, r.kept) for r in exact_dedup.exact_dedup(clashing, **options).collect()}
    assert got == {k: (*v, v[0] == k) for k, v in brute.exact(DOCS).items()}


def test_directory_splits_and_doubles():
    hashes = [0] * 5 + [1 << 61] * 5 + [14 << 60] * 5 + [15 << 60] * 4
    seen = []

    def count(prefixes, depth, deeper):
        seen.append((prefixes, depth, deeper))
        out = {}
        for h in hashes:
            if h >> (64 - depth) in prefixes:
                out[h >> (64 - deeper)] = out.get(h >> (64 - deeper), 0) + 1
        return out

    assert exact_dedup.directory(19, count, 6, 3) == [(0, 3), (1, 3), (1, 2), (2, 2), (6, 3), (14, 4), (15, 4)]
    assert seen == [([0], 0, 3), ([7], 3, 7)]  # nine of one prefix are counted again, further down
    assert exact_dedup.directory(6, count, 6, 3) == [(0, 0)]


def test_the_index_settles_rows(spark, docs):
    """Buckets hold no more than their capacity unless one hash does; every record is in one entry; chains are numbered."""
    scratch = Scratch(spark, "t")
    one = docs.select("doc_id", "text")
    records = scratch.write(one.mapInArrow(exact_dedup._records(lambda norm: (len(norm) % 7 - 3) << 60, 10**6), exact_dedup.RECORD), "records")
    index = exact_dedup.build_index(scratch, records, one, 3).collect()
    assert sorted(r.record for r in index) == sorted(r.record for r in records.collect())
    per = {}
    for r in index:
        per.setdefault(r.bucket, set()).add(r.h)
    assert len(per) > 1 and all(len(h) == 1 for h in per.values())
    entries = {(r.h, r.chain): r.sha for r in index}
    assert len(set(entries.values())) == len(entries) and {r.chain for r in index} > {0}


def test_jaccard_join(clashing):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(clashing).collect()}
    assert got == brute.jaccard(DOCS)


@pytest.mark.parametrize(("frequent", "fragments"), [(2, 1), (1000, 4)])
def test_jaccard_join_near_the_threshold(spark, frequent, fragments):
    rows = []
    for _ in range(25):
        base = prose(60)
        rows += [base, *(edited(base, r) for r in (0.01, 0.02, 0.03, 0.04, 0.05)), base + " " + prose(9), base[: len(base) * 9 // 10]]
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(df, frequent_from=frequent, fragments=fragments).collect()}
    assert got == brute.jaccard(rows)


@pytest.mark.parametrize("split_from", [1, 4, 30])
def test_jaccard_join_of_split_shingles(spark, split_from):
    """Passages that very many unlike documents share, near copies among them: cells of any size find the same links."""
    passages = [prose(12) for _ in range(3)]
    texts = [f"{passages[k % 3]} {prose(14)}" for k in range(90)]
    texts += [edited(t, 0.02) for t in texts[:30]] + [f"{p} {prose(2)}" for p in passages for _ in range(6)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(df, split_from=split_from).collect()}
    want = brute.jaccard(rows)
    assert got == want and len({c for _, c in want.values()}) < len(rows) - 10


def test_split_shingle_meets_all_pairs_in_small_cells():
    import pyarrow as pa

    mark = np.array([(77 | 1, 3), (1001, 5)], jaccard_join.MARK)
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array([9] * 500), pa.array([[mark.tobytes()]] * 500)], names=["doc_id", "n", "marks"])
    out = next(jaccard_join.split_marks(np.array([77], np.uint64), np.array([10]))([batch]))
    cells, plain = {}, set()
    for doc, lists in zip(out.column(0).to_pylist(), out.column(2).to_pylist(), strict=True):
        for h, pos in np.frombuffer(lists[0], jaccard_join.MARK).tolist():
            if h == 1001:
                plain.add(doc)
            else:
                assert pos == 3
                cells.setdefault(h, set()).add(doc)
    assert len(plain) == 500 and len(cells) == 55 and max(map(len, cells.values())) <= 160
    assert len({(a, b) for c in cells.values() for a in c for b in c if a < b}) == 500 * 499 // 2


def test_jaccard_join_of_a_large_group_below_the_threshold(spark):
    """700 edits of one text, most of them just short of each other."""
    base = prose(150)
    rows = list(enumerate([base, *(edited(base, random.choice((0.01, 0.02, 0.03, 0.04))) for _ in range(700))]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(df).collect()}
    assert got == brute.jaccard(rows)


def test_sketches_differ_no_more_than_sets():
    rng = np.random.default_rng(2)
    sets = []
    for n in (1, 4, 90, 130, 600):
        base = rng.integers(0, 2**63, n, dtype=np.uint64)
        sets += [base, np.unique(np.concatenate([base[: n * 9 // 10], rng.integers(0, 2**63, n // 5 + 1, dtype=np.uint64)]))]
    raw = [jaccard_join.sketches(s, np.zeros(len(s), np.int64), np.array([len(s)]))[0] for s in sets]
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    apart = jaccard_join.Sketches(raw).differ(a, b)
    true = np.array([len(set(sets[i].tolist()) ^ set(sets[j].tolist())) for i, j in zip(a, b, strict=True)])
    assert (apart <= true).all() and (apart[a == b] == 0).all() and apart[true > 20].min() > 0


def thue_morse(n, one, other, join=""):
    return join.join((one, other)[bin(i).count("1") & 1] for i in range(n))


def test_texts_that_polynomial_hashes_confuse(spark, library):
    """Thue-Morse words, and sequences of words, and their complements."""
    texts = [t for n in (512, 1024, 2048, 8192) for t in (thue_morse(n, "a", "b"), thue_morse(n, "b", "a"), thue_morse(n, "a ", "b "), thue_morse(n, "b ", "a "))]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(df).collect()} == {k: len(library(t)) for k, t in rows}
    digest = {k: hashlib.sha256(np.array(library(t), "<u4").tobytes()).hexdigest() for k, t in rows}
    assert {r.doc_id: r.ids_sha256 for r in bpe_codec.round_trip(df).collect()} == digest
    for r in packing.pack(df).collect():
        assert r.ids_crc32 == zlib.crc32(np.array([*library(texts[r.doc_id]), 1][r.start : r.start + r.length], "<u4").tobytes())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(df).collect()} == brute.substring(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(df).collect()} == brute.jaccard(rows)


def test_rows_of_one_id_and_without_one(spark):
    """They are documents of their own in every operator; an id is never invented."""
    base = prose(60)
    rows = [(1, base), (1, base), (1, "other words"), (2, base + " "), (None, base), (None, "a@b.cc said"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ids = sorted((k for k, _ in rows), key=str)
    labels = spark.createDataFrame([(1, 1, None), (2, 0, None)], "doc_id long, quality int, toxic int")
    for out in (token_counts.token_counts(df), bpe_codec.round_trip(df), quality_crf.quality_scores(df, labels)):
        assert sorted((r.doc_id for r in out.collect()), key=str) == ids
    assert sorted((r.doc_id for r in packing.pack(df).where("start = 0").collect()), key=str) == ids
    removed = sorted((str(r.doc_id), r.n_removed) for r in substring_dedup.substring_dedup(df).collect())
    assert removed == [("1", 0), ("1", 0), ("1", 60), ("2", 60), ("3", 0), ("None", 0), ("None", 60)]
    near = sorted((str(r.doc_id), str(r.component_id)) for r in jaccard_join.jaccard_join(df).collect())
    assert near == [("1", "1")] * 3 + [("2", "1"), ("3", "3"), ("None", "1"), ("None", "None")]
    exact = exact_dedup.exact_dedup(df).collect()
    assert sorted(str(r.doc_id) for r in exact if r.kept) == ["1", "2", "3", "None"] and sum(r.keep_id == 2 for r in exact) == 4
    assert sorted(r.n_email for r in pii.pii_spans(df).collect()) == [0] * 6 + [1]
    assert sorted(r.text or "" for r in pii.sanitise(df).collect()) == sorted((t or "").replace("a@b.cc", "[EMAIL]") for _, t in rows)
    v = [(1, [1.0, 2.0]), (1, [2.0, 4.0]), (1, [-1.0, 0.5]), (None, [1.0, 2.0]), (5, None)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(v, "vec_id long, embedding array<double>")).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == [("1", 0, "1", True), ("1", 2, "1", False), ("1", 2, "1", True), ("5", 0, "5", True), ("None", 2, "1", False)]


def test_substring_dedup(clashing):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(clashing, with_text=True).collect()}
    assert got == brute.substring(DOCS)


@pytest.mark.parametrize("window", [8, 20])
def test_substring_dedup_of_few_words(spark, window):
    rows = [(k, " ".join(random.choices("ab", k=random.randint(0, 60)))) for k in range(60)]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), window=window).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute.substring(rows, window)


ODD_PII = [
    "mail a.b@c-d.org, x@y.z_w@e.fr and @no at@no", "1.2.3.4.5.6.7.8 256.1.1.1 010.002.0.1 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111110000", "+1 (706) 555-3138 +44 20 +123456789012345678 ++12345678",
    "1 " * 3000 + "9" * 5000, "a" * 20000 + "@b.cc", "é😀 4111111111111111 +4915112345678", "1.1.1.1 " * 500, None, "",
]


def test_pii_base(spark):
    rows = list(enumerate(ODD_PII))
    got = pii.pii_spans(spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("place", "kind", "spans", "m", "told", "value")})).collect()
    for r in got:
        want = brute.pii(ODD_PII[r.doc_id])
        assert r.spans == ",".join(want) and r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k + ":") for w in want) for k in brute.PII]


def test_pii_terms_that_reveal_an_entity(spark):
    told = [f"{w} said Quentinix of {v} mail q@x.org to {w} Quentinix" for w, v in zip(VOCABULARY[:8], VOCABULARY[8:16], strict=True)]
    rows = list(enumerate([*told, *(f"said of mail to {prose(10)}" for _ in range(200)), "Quentinix alone is told nothing"]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pii_spans(df, least=5).collect()}
    assert all(got[k].n_term == 2 and "email:" in got[k].spans for k in range(8)) and got[250 - 42].n_term == 0
    clean = {r.doc_id: r.text for r in pii.sanitise(df, least=5).collect()}
    assert "Quentinix" not in clean[0] and "[EMAIL]" in clean[0] and "q@x.org" not in clean[0] and "said" in clean[0]
    assert clean[208] == "Quentinix alone is told nothing" and clean[100] == rows[100][1]


def test_pii_terms_of_a_rare_entity(spark):
    """What is met beside an entity in one line, or two, or in copies of one, tells nothing; in eight unlike lines it does, short and numeric terms too."""
    lines = ["said Zerbino of mail b@y.org to 7719", "said Qx of mail c@y.org", "mail Qx said c@y.org", *["said Copin of mail d@y.org to"] * 30]
    lines += [f"{w} said Zy of {v} mail e@y.org 4471" for w, v in zip(VOCABULARY[:8], VOCABULARY[8:16], strict=True)]
    rows = list(enumerate([*lines, *(f"said of mail to {prose(10)}" for _ in range(200)), "elsewhere said Qx alone"]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_term for r in pii.pii_spans(df).collect()}
    assert not any(got[k] for k in range(33)) and all(got[k] == 2 for k in range(33, 41)) and sum(got.values()) == 16
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[0] == "said Zerbino of mail [EMAIL] to 7719" and clean[33] == f"{VOCABULARY[0]} said [NAME] of {VOCABULARY[8]} mail [EMAIL] [NUMBER]" and clean[241] == rows[241][1]


def test_pii_terms_far_along_the_line(spark):
    """A term 600 characters from the entity on its line counts, one on the next line doesn't; no word is cut; counts are of whole lines."""
    far = "said of mail " * 50
    line = lambda k: f"Zerbino {far}{VOCABULARY[k]} \u00e9\U0001F600 b@y.org, +14155550123 {far}Quorl"
    rows = list(enumerate([*(line(k) + "\nNextline" for k in range(20)), *(f"said of mail to {prose(10)}" for _ in range(200))]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.sanitise(df, remove_at=0.99).collect()}
    assert got[0] == f"[NAME] {far}{VOCABULARY[0]} [WORD]\U0001F600 [EMAIL], [PHONE] {far}[NAME]\nNextline" and all(got[k] == t for k, t in rows[20:])
    assert pii.sanitise(df).where("doc_id = 0").first().text == f" {far}{VOCABULARY[0]} \U0001F600 [EMAIL], [PHONE] {far}\nNextline"  # 20 lines: removed
    held = pii._lines_of_entities(df.where("doc_id = 0"), pii.base_spans(df)).collect()
    assert [(sorted(r.entities), r.line) for r in held] == [(["email:b@y.org", "phone:+14155550123"], rows[0][1].split("\n")[0])]


def planted_terms(n_noise, seed=8):
    """Documents with 12 addresses in 12 unlike lines each, which a name of each gives away; decoys: words met once beside an address, in half of its lines and elsewhere too, beside all addresses."""
    r = random.Random(seed)
    docs, names = [], {f"email:user{k}@x.org": f"nickname{k}" for k in range(12)}
    for k, (entity, name) in enumerate(names.items()):
        for n in range(12):
            docs.append(" ".join([name, r.choice(VOCABULARY), f"once{k}x{n}", f"half{k}" if n % 2 else "none", "signed", entity.split(":")[1], r.choice(VOCABULARY)]))
        docs += [f"half{k} and {r.choice(VOCABULARY)}" for _ in range(12)]
    docs += [f"signed {prose(8)}" for _ in range(n_noise)]
    return list(enumerate(docs)), names


def test_terms_of_planted_entities_and_no_decoys(spark):
    """Precision and recall of the disclosing terms, the same in a corpus many times as large."""
    for n_noise in (300, 30_000):
        rows, names = planted_terms(n_noise)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        _, terms = pii.find_pii(df)
        assert {(t.entity, t.term) for t in terms.collect()} == set(names.items())


def test_disclosure_does_not_move_with_the_corpus(spark):
    """The same evidence in 10**3, 10**6 and 10**12 lines."""
    rows = spark.createDataFrame([(1, 1), (4, 4), (5, 5), (8, 9), (50, 100), (1000, 1000)], "k long, n long")
    got = [(r.k, r.n, r.b) for r in rows.select("k", "n", pii.least_share(F.col("k"), F.col("n"), 1.645).alias("b")).collect()]
    assert all(b == pytest.approx(brute.least_share(k, n)) for k, n, b in got)
    for k, n, b in got:
        told = [(b - k / total) / (1 - k / total) for total in (1e6, 1e12)]
        assert abs(told[0] - told[1]) < 0.002 and 0 <= b < k / n
    assert [b >= 0.5 for *_, b in got] == [False, False, True, True, False, True]


def test_many_spans_of_one_document_cost_time_in_proportion(spark):
    import time

    text = " ".join(f"{w} u{k}@x{k % 7}.org é😀" for k, w in enumerate(random.choices(VOCABULARY, k=4000)))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    pii.sanitise(df.limit(0)).count()
    began = time.perf_counter()
    got = pii.sanitise(df).first().text
    assert time.perf_counter() - began < 40 and got.count("[EMAIL]") == 4000 and "@" not in got
    cuts = [(1, a, b, p) for a, b, p in ((0, 2, "x"), (1020, 1030, "y"), (1500, 3200, "zz"), (5000, 5000, "!"), (8191, 8192, ""))]
    plain, at = "", 0
    for _, a, b, p in cuts:
        plain, at = plain + text[at:a] + p, b
    made = df.join(pii.by_chunk(spark.createDataFrame(cuts, "doc_id long, start int, end int, put string"), "doc_id"), "doc_id")
    assert made.select(pii.cut_out(F.col("text"), F.col("cuts"))).first()[0] == plain + text[at:]


def test_disclosures_equal_plain_counts(spark):
    names = ["Quorl", "Zerb", "7719", "x9y", "said", "to"]
    mails = ["a@b.cc", "c@d.ee", "+14155550123"]
    texts = ["\n".join(" ".join(random.choices([*names, *VOCABULARY[:20]], k=6) + random.choices([*mails, "", "", ""], k=2)) for _ in range(random.randint(1, 6))) for _ in range(80)]
    rows = list(enumerate([*texts, None, "", texts[0], *(prose(12) for _ in range(60))]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    scratch = Scratch(spark, "t")
    got = pii.disclosing_terms(df.fillna(""), pii.base_spans(df.fillna("")), scratch, least=1, z=1.645, generalise_at=-99.0).collect()
    want = brute.disclosures(rows)
    assert {(r.entity, r.term) for r in got} == set(want) and want
    assert all(abs(r.disclosure - want[r.entity, r.term]) < 1e-9 for r in got)


def test_sanitise_overlaps_and_keeps_columns(spark):
    rows = [(1, "call +14155550123, 4111111111111111 or a@b.cc!", "x"), (2, None, "y"), (3, "plain", "z")]
    got = {r.doc_id: (r.text, r.spans) for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()}
    assert got == {1: ("call [PHONE], [CARD] or [EMAIL]!", "x"), 2: (None, "y"), 3: ("plain", "z")}


def vectors(n=600, d=16, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[100:180] = x[100] + rng.normal(size=(80, d)) * 0.03  # near copies
    x[200:230] = x[200]  # copies
    x[300:310] = x[300] * np.arange(1, 11)[:, None]  # one direction
    return x.astype(np.float32)


@pytest.mark.parametrize("block", [2048, 64])
def test_near_duplicates(spark, block):
    x = vectors()
    rows = [(k, [float(c) for c in v], "z") for k, v in enumerate(x)]
    rows += [(1000, None, ""), (1001, [], ""), (1002, [0.0] * 16, ""), (1003, [1.0] * 15 + [None], ""), (1004, [1.0] * 15 + [float("nan")], ""), (1005, [1.0, 2.0], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard string").repartition(5)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, block=block).collect()}
    u = embedding_dedup.unit(x)
    near = u @ u.T >= 0.95
    links = near.sum(1) - 1
    found = np.array([got[k].n_links for k in range(len(x))])
    assert (found <= links).all() and found.sum() >= 0.97 * links.sum()
    root = brute.union_find(range(len(x)), zip(*np.nonzero(np.triu(near, 1)), strict=True))
    assert np.mean([got[k].component_id == root[k] for k in range(len(x))]) > 0.97
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in range(1000, 1006))
    assert all(got[k].n_links >= 29 for k in range(200, 230))


def hot_vectors(n, share, spread, d=64, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    hot = rng.permutation(n)[: int(n * share)]
    x[hot] = x[hot[0]] + rng.normal(size=(len(hot), d)) * spread
    return x.astype(np.float32)


@pytest.mark.parametrize("spread", [0.08, 0.2])
def test_near_duplicates_of_a_dense_group(spark, spread):
    """A third of the vectors in one group, tight or loose, over many shards and blocks."""
    x = hot_vectors(4000, 1 / 3, spread)
    u = embedding_dedup.unit(x)
    near = u @ u.T >= 0.95
    df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, block=128).collect()}
    found, links = np.array([got[k].n_links for k in range(len(x))]), near.sum(1) - 1
    assert (found <= links).all() and found.sum() >= embedding_dedup.TARGET_RECALL * links.sum() and got[0].recall >= embedding_dedup.TARGET_RECALL


def test_near_duplicates_over_many_shards(spark):
    """20,000 vectors around 4,000 points: recall over all pairs, and as the operator tells it."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 64))[rng.integers(0, 4000, 20_000)] + rng.normal(size=(20_000, 64)) * 0.16
    u = embedding_dedup.unit(x)
    links = np.concatenate([(u[a : a + 2000] @ u.T >= 0.95).sum(1) - 1 for a in range(0, len(u), 2000)])
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(8)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, block=512).collect()}
    found = np.array([got[k].n_links for k in range(len(x))])
    assert links.sum() > 10_000 and (found <= links).all() and found.sum() >= 0.97 * links.sum() and got[0].recall >= 0.97


def test_the_audit_widens_routing(spark):
    """Where one centre a vector loses links, vectors go to more."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 6))
    u = embedding_dedup.unit(x)
    links = (u @ u.T >= 0.95).sum(1) - 1
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, block=100, overlap=1, sample=200).collect()}
    found = np.array([got[k].n_links for k in range(len(x))])
    assert (found <= links).all() and found.sum() >= 0.98 * links.sum() and got[0].recall >= embedding_dedup.TARGET_RECALL


def test_lengths_and_precision(spark):
    v = [[1.0, 2.0], [2.0, 4.0], [1e300] * 3, [1e300] * 3, [1e-310, 1e-310, 1e-310], [1.0, 1.0], None]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")).collect()}
    assert [got[k].n_links for k in range(7)] == [1, 1, 2, 2, 2, 0, 0]


def test_graph_reaches_all():
    x = embedding_dedup.unit(np.concatenate([vectors(400), -vectors(400, seed=9)[:50]]))
    graph = embedding_dedup.build_graph(x)
    seen, front = set(), set(embedding_dedup.medoids(x).tolist())
    while front:
        seen |= front
        front = {int(j) for i in front for j in graph[i]} - seen
    assert len(seen) == len(x)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 300)] + [(500, k) for k in range(501, 900)] + [(1000, 1000)]
    random.shuffle(edges)
    got = components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long"))
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert {r.node: r.component for r in got.collect()} == brute.union_find(nodes, [e for e in edges if e[0] != e[1]])
    assert components(Scratch(spark, "t"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality(spark):
    good = [". ".join(prose(9).capitalize() for _ in range(4)) + ".\n" + prose(30) + "." for _ in range(120)]
    bad = [" ".join(f"{w.upper()}!! ###" for w in prose(30).split()) for _ in range(60)]
    rows = list(enumerate([*good, *bad, None, ""]))
    labels = spark.createDataFrame([(k, int(k < 120), None) for k, _ in rows[:180]] + [(5, None, 1)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit(0)).repartition(4)
    got = {r.doc_id: r for r in quality_crf.quality_scores(df, labels).collect()}
    held = [k for k, _ in rows[:180] if got[k].held_out]
    assert held and all(zlib.crc32(str(k).encode()) % 4 == 2 for k in held)
    assert np.mean([got[k].predicted == int(k < 120) for k in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == len(rows) and got[180].score == got[181].score
    none = quality_crf.quality_scores(df, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in none] == [1.0]


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    emit, move = rng.normal(size=4), rng.normal(size=(2, 2))
    got, pair, log_z = quality_crf.Chains(np.zeros(4, int)).marginals(emit, move)
    weights = {}
    for y in np.ndindex(2, 2, 2, 2):
        weights[y] = np.exp(sum(emit[t] * y[t] for t in range(4)) + sum(move[y[t], y[t + 1]] for t in range(3)))
    z = sum(weights.values())
    assert np.allclose(got, [sum(w for y, w in weights.items() if y[t]) / z for t in range(4)]) and np.isclose(log_z, np.log(z))
    assert np.allclose(pair[1, 0], sum(w / z * sum(y[t] == 1 and y[t + 1] == 0 for t in range(3)) for y, w in weights.items()))


MESSAGES = [
    (1, 0, "user", "Hello there friend.\nHow do I sort a list?"), (1, 1, "assistant", "Use sorted().\n\nIt returns a new list."), (1, 2, "user", "Thanks, what about tuples?"), (1, 3, "assistant", "Same thing."),
    (1, 4, "user", "Bob wrote:\n> Use  SORTED().\n>\n> It returns a new list.\nDoes it work in place?"), (1, 5, "assistant", "No."), (1, 6, "user", "> > Use sorted().\n> Does it work in place?\nReally?"),
    (1, 6, "user", "> > Use sorted().\n> Does it work in place?\nReally?"), (2, 0, "user", "> Same thing.\nI saw this elsewhere"), (3, None, None, None), (None, 1, "user", "x > y"), (4, 0, "user", "> nobody said this\n\nok"), (5, 2500, "user", "far\n" * 3000),
]


def test_quote_links(spark):
    df = spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("mid", "group", "branch", "level", "path")}).repartition(3)
    rows = quote_links.link_conversations(df).collect()
    assert len(rows) == len(MESSAGES)
    order = [r.turn for r in sorted((r for r in rows if r.conv_id == 1), key=lambda r: r.reply_path)]
    assert order == [0, 1, 4, 6, 6, 5, 2, 3]
    by = {(r.conv_id, r.turn): r for r in rows}
    assert by[1, 4].reply_to == 1 and by[1, 4].text == "Does it work in place?" and by[1, 4].n_quotes == by[1, 4].n_linked == 1
    assert by[1, 6].reply_to == 4 and by[1, 6].max_level == 2 and by[1, 6].text == "Really?"
    assert by[2, 0].reply_to is None and by[2, 0].outside == 1 and by[4, 0].n_linked == 0 and by[4, 0].text == "\nok"
    assert by[3, None].text is None and by[None, 1].text == "x > y" and by[5, 2500].text == "far\n" * 3000


def quoting(rng):
    """Conversations of up to 12 turns whose messages quote earlier ones, at random levels, and each other."""
    lines = ["Hello there", "how are  you", "fine", "not so FINE", "see below", "ok", "why not?", "Bob wrote:"]
    out = []
    for conv in range(12):
        said = []
        for turn in range(rng.randint(1, 12)):
            parts = []
            for _ in range(rng.randint(0, 3)):
                if said and rng.random() < 0.7:
                    mark = rng.choice(["> ", ">> ", "> > ", " >"])
                    parts += [mark + x for x in rng.choice(said).split("\n")[: rng.randint(1, 3)]]
                parts += rng.choices(lines, k=rng.randint(0, 2)) + rng.choice([[], [""]])
            text = "\n".join(parts)
            said.append(text)
            out.append((conv, turn, text))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quote_links_equal_plain_ones(spark, seed):
    messages = quoting(random.Random(seed))
    told, order = brute.quote_links(messages)
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in messages], "conv_id long, turn long, role string, text string").repartition(3)
    rows = quote_links.link_conversations(df).collect()
    assert {(r.conv_id, r.turn): (r.reply_to, r.n_quotes, r.n_linked, r.outside) for r in rows} == told and sum(r.n_linked for r in rows) > 20
    got = {}
    for r in sorted(rows, key=lambda r: r.reply_path):
        got.setdefault(r.conv_id, []).append(r.turn)
    assert got == order


def test_quote_links_nested_deeply(spark):
    """40 branches, each in the one before; turns of any size sort."""
    turns = [-5, 0, 7, *range(10**12, 10**12 + 40)]
    rows = [(1, t, "user", (f"> line {turns[max(0, k - 2)]}\n" if k > 1 else "") + f"line {t}") for k, t in enumerate(turns)]
    got = quote_links.link_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    told, order = brute.quote_links([(c, t, x) for c, t, _, x in rows])
    assert {(r.conv_id, r.turn): r.reply_to for r in got} == {k: v[0] for k, v in told.items()}
    assert [r.turn for r in sorted(got, key=lambda r: r.reply_path)] == order[1] and max(len(r.reply_path) for r in got) > 20 * 40


def test_empty_tables(spark, empty):
    assert token_counts.token_counts(empty).count() == 0 and bpe_codec.round_trip(empty).count() == 0 and packing.pack(empty).count() == 0
    assert exact_dedup.exact_dedup(empty).count() == 0 and jaccard_join.jaccard_join(empty).count() == 0 and substring_dedup.substring_dedup(empty).count() == 0
    assert pii.pii_spans(empty).count() == 0 and pii.sanitise(empty).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_crf.quality_scores(empty, labels).count() == 0
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert quote_links.link_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_rows_equal_sql(spark, name):
    assert_same(registry.queries()[name](spark, SMALL), registry.oracle_sql()[name], SMALL)


def test_messages_that_differ_in_nulls_are_two(spark):
    """A role and a text change places with a null: each row keeps its own quotes, or none."""
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", "a b c d"), (1, 1, None, "> a b c d\nyes"), (1, 1, "> a b c d\nyes", None), (1, 1, "> a b c d\nyes", ""), (None, 1, "x", None), (None, None, "x", "")]
    got = quote_links.link_conversations(spark.createDataFrame(rows, schema)).collect()
    quotes = {(r.conv_id, r.turn, r.role, r.text): (r.n_quotes, r.n_linked) for r in got}
    assert quotes == {
        (1, 0, "user", "a b c d"): (0, 0), (1, 1, None, "yes"): (1, 1), (1, 1, "> a b c d\nyes", None): (0, 0), (1, 1, "> a b c d\nyes", ""): (0, 0),
        (None, 1, "x", None): (0, 0), (None, None, "x", ""): (0, 0),
    }
    ids = spark.createDataFrame(rows, schema).select(quote_links.message_id("conv_id", "turn", "role", "text")).distinct()
    assert ids.count() == len(rows)


def planted_families(hub=400, families=120, d=24, seed=6):
    """Vectors: a hub that all link, families of three, and loners; ids in turn, so that queries meet all kinds."""
    r = np.random.default_rng(seed)
    near = lambda base, n: base + r.normal(size=(n, d)) * 0.04 / np.sqrt(d) * np.linalg.norm(base)
    rows = [*near(r.normal(size=d), hub), *(x for _ in range(families) for x in near(r.normal(size=d), 3)), *r.normal(size=(300, d))]
    return [(k, [float(x) for x in rows[i]]) for k, i in enumerate(r.permutation(len(rows)))]


def test_embedding_audit_sees_families_that_are_lost(spark):
    """Families hold few of the links: an index that loses them all has most links, and a bad recall all the same."""
    rows = planted_families()
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = ((x @ x.T) >= 0.95).sum(1) - 1
    firsts = spark.createDataFrame([(k, 1, v) for k, v in rows], "vec_id long, copies long, v array<double>")
    found = lambda few: spark.createDataFrame([(k, int(n)) for k, n in enumerate(links) if n > few], "vec_id long, links long")
    assert embedding_dedup.audit(firsts, found(0), 0.95, 10**6) == 1.0
    asked = [int(n) for k, n in enumerate(links) if k % 50 == 0 and n]
    assert sum(n for n in asked if n > 2) / sum(asked) > 0.99  # by links alone all would be well
    assert embedding_dedup.audit(firsts, found(2), 0.95, 10**6) < 0.7
    assert embedding_dedup.audit(firsts.limit(0), found(0), 0.95, 10) is None


def test_embedding_families_beside_a_hub_are_all_found(spark, tmp_path):
    """The planted table's rows equal the SQL's, its recall too."""
    spark.createDataFrame(planted_families(), "vec_id long, embedding array<double>").withColumn("label", F.lit(0)).coalesce(1).write.parquet(f"{tmp_path}/all")
    next((tmp_path / "all").glob("*.parquet")).rename(tmp_path / "embeddings.parquet")
    got = embedding_dedup.near_duplicates(table(spark, str(tmp_path), "embeddings"), block=64)
    assert_same(got, registry.oracle_sql()["op2_embedding_dedup"], str(tmp_path))
    assert got.first().recall == 1.0
