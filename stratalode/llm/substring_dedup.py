"""Substring dedup by level-wise doubling.

Windows that repeat at one length alone are extended to twice that length,
until the wanted length is reached or no candidates survive: 5, 10, 20 words,
one round of owner tasks for each.

Of each wanted window (20 words) one 5-word window, the one of smallest hash,
stands for it at the first level; neighbouring windows mostly share it, so a
candidate is a place with a run of windows.

* 5 words: a place whose 5-word window is met once ends there. One whose whole
  stretch equals an earlier one is covered as a whole, and settled.
* 10 words: of the others those survive that share the 10 words up to the
  5-word window's end, or the 10 from its beginning, with another.
* 20 words: each window of the survivors has its own hashes; one that starts
  earlier elsewhere covers its words.

Owner tasks each take a range of hashes. Before anything is sent a task settles
what repeats inside its own documents: of equal windows it passes on the first,
and of one 5-word window with many unlike stretches a few, as it knows that all
repeat. So a passage in a third of all documents is a few records per task.
Windows are compared by 128 bits of hashes at the last level; stretches by 64
of the 5-word window and 61 of the whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan
from .bpe import chunks
from .common import Scratch, given_ids, lean, own_rows, table
from .jaccard_join import _batches

#: key and same: hashes by which places are equal (key alone brings candidates
#: together); the stretch is ``run`` windows from word ``start`` of document ``doc``.
PLACE = np.dtype([("key", "<u8"), ("same", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("run", "<i4")])
#: blobs of places for an owner, or what is known of a document's spans: covered, or open for the next level
KINDS = "part int, blob binary, doc_id long, spans binary, open boolean"
SPAN = np.dtype([("start", "<i4"), ("run", "<i4")])
#: unlike stretches of one 5-word window that a task sends; more aren't needed to know that it repeats
SENT = 64


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest of each ``width`` neighbours."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, place, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        later = best[step:] < best[:-step]
        place = np.where(later, place[step:], place[:-step])
        best = np.where(later, best[step:], best[:-step])
        have += step
    return place[:n]


def _runs(w: textscan.Words, window: int):
    """(hashes of the short windows, first windows of runs that share the smallest one, lengths of the runs, places of the smallest)."""
    base = window // 4
    n = max(0, len(w.hashes) - window + 1)
    small = textscan.window_hashes(w.hashes, base)
    anchor = sliding_argmin(small, window - base + 1)
    inside = w.owner[np.arange(n) + window - 1] == w.owner[:n]
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (w.owner[1:n] != w.owner[: n - 1]) if n else new[1:]
    new &= inside
    s = np.flatnonzero(new)
    # Runs end before the next run or the document's last window.
    group = np.cumsum(new) - 1
    run = np.bincount(group[inside], minlength=len(s)) if len(s) else np.zeros(0, np.int64)
    return small, s, run, anchor[s] if n else s


def candidates(texts: list[str], ids: np.ndarray, window: int) -> np.ndarray:
    """Places of the first level of a batch of texts."""
    w = textscan.words([t.encode() for t in texts])
    small, s, run, a = _runs(w, window)
    out = np.empty(len(s), PLACE)
    if len(s):
        out["key"] = small[a]
        out["same"] = textscan.stretch_hashes(w.hashes, s, s + run + window - 1) ^ (a - s).astype(np.uint64)
        out["doc"], out["start"], out["run"] = ids[w.owner[s]], s - w.first[w.owner[s]], run
    return out


def extensions(texts: list[str], ids: np.ndarray, spans: list[bytes], window: int) -> np.ndarray:
    """Places of the second level, for the spans that are given of each text: one for each extension of the short window that fits the text."""
    w = textscan.words([t.encode() for t in texts])
    _, s, run, a = _runs(w, window)
    base = window // 4
    wanted = [np.frombuffer(blob, SPAN)["start"].astype(np.int64) + w.first[i] for i, blob in enumerate(spans)]
    open_ = np.isin(s, np.concatenate(wanted)) if wanted else np.zeros(len(s), bool)
    s, run, a = s[open_], run[open_], a[open_]
    twice = textscan.window_hashes(w.hashes, 2 * base)
    first, last = w.first[w.owner[s]], w.first[w.owner[s] + 1]
    found = []
    for at in (a - base, a):
        fits = (at >= first) & (at + 2 * base <= last)
        out = np.zeros(int(fits.sum()), PLACE)
        out["key"] = twice[at[fits]]
        out["doc"], out["start"], out["run"] = ids[w.owner[s[fits]]], (s - first)[fits], run[fits]
        found.append(out)
    return np.concatenate(found)


def windows(texts: list[str], ids: np.ndarray, spans: list[bytes], window: int) -> np.ndarray:
    """Places of single windows, for the spans that are given of each text."""
    raw = [t.encode() for t in texts]
    w = textscan.words(raw)
    whole, other = textscan.window_hashes(w.hashes, window), textscan.window_hashes(textscan.words(raw, salt=1).hashes, window)
    starts, owner = [], []
    for i, blob in enumerate(spans):
        sp = np.frombuffer(blob, SPAN)
        run = sp["run"].astype(np.int64)
        at = np.repeat(sp["start"] - (np.cumsum(run) - run), run) + np.arange(int(run.sum()))
        starts.append(np.unique(at) + w.first[i])
        owner.append(np.full(len(starts[-1]), i))
    if not starts or not len(whole):
        return np.zeros(0, PLACE)
    s, o = np.concatenate(starts).astype(np.int64), np.concatenate(owner)
    out = np.zeros(len(s), PLACE)
    out["key"], out["same"] = whole[s], other[s]
    out["doc"], out["start"], out["run"] = ids[o], s - w.first[o], 1
    return out


def _by_doc(doc: np.ndarray, places: np.ndarray):
    """(doc, blob of spans), one row per document."""
    order = np.argsort(doc, kind="stable")
    doc, places = doc[order], places[order]
    spans = np.empty(len(places), SPAN)
    spans["start"], spans["run"] = places["start"], places["run"]
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    stop = np.append(first[1:], len(doc))[: len(first)]
    return doc[first], [spans[a:b].tobytes() for a, b in zip(first.tolist(), stop.tolist(), strict=True)]


def settle(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each stretch, later ones: these are covered)."""
    places = places[np.lexsort((places["start"], places["doc"], places["same"], places["key"]))]
    again = np.zeros(len(places), bool)
    again[1:] = (places["key"][1:] == places["key"][:-1]) & (places["same"][1:] == places["same"][:-1])
    return places[~again], places[again]


def _met_again(places: np.ndarray) -> np.ndarray:
    """Which of the places, sorted by key, share theirs with another."""
    pair = places["key"][1:] == places["key"][:-1]
    out = np.zeros(len(places), bool)
    out[1:] |= pair
    out[:-1] |= pair
    return out


def _place_in_key(places: np.ndarray) -> np.ndarray:
    """Number of each place, sorted by key, among those of its key."""
    at = np.arange(len(places))
    new = np.ones(len(places), bool)
    new[1:] = places["key"][1:] != places["key"][:-1]
    return at - np.maximum.accumulate(np.where(new, at, 0)) if len(at) else at


def _first_level(places: np.ndarray, owner: bool):
    """(places to send, covered, open)."""
    firsts, covered = settle(places)
    if owner:
        return firsts[:0], covered, firsts[_met_again(firsts)]
    sent = _place_in_key(firsts) < SENT
    return firsts[sent], covered, firsts[~sent]


def _middle_level(places: np.ndarray, owner: bool):
    places = places[np.lexsort((places["start"], places["doc"], places["key"]))]
    sent = places[:0] if owner else places[_place_in_key(places) == 0]
    return sent, places[:0], places[_met_again(places)]


def _last_level(places: np.ndarray, owner: bool):
    firsts, covered = settle(places)
    return firsts[: 0 if owner else None], covered, firsts[:0]


def _told(places: np.ndarray, parts: int, covered: np.ndarray, open_: np.ndarray):
    part = (places["key"] >> np.uint64(32)).astype(np.int64) % parts
    order = np.argsort(part, kind="stable")
    places, part = places[order], part[order]
    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    stop = np.append(at[1:], len(part))[: len(at)]
    blobs = [places[a:b].tobytes() for a, b in zip(at.tolist(), stop.tolist(), strict=True)]
    (docs, spans), (open_docs, open_spans) = (_by_doc(x["doc"], x) for x in (covered, open_))
    k, d, o = len(blobs), len(docs), len(open_docs)
    return pa.RecordBatch.from_arrays(
        [
            pa.concat_arrays([pa.array(part[at], pa.int32()), pa.nulls(d + o, pa.int32())]),
            pa.array([*blobs, *[None] * (d + o)], pa.binary()),
            pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(docs, pa.int64()), pa.array(open_docs, pa.int64())]),
            pa.array([*[None] * k, *spans, *open_spans], pa.binary()),
            pa.array([*[None] * k, *[False] * d, *[True] * o], pa.bool_()),
        ],
        names=["part", "blob", "doc_id", "spans", "open"],
    )


def _mapper(find, rule, parts: int, most: int = 1_500_000):
    def run(batches):
        held, n = [], 0
        for found in find(batches):
            held.append(found)
            n += len(found)
            if n > most:
                sent, covered, open_ = rule(np.concatenate(held), False)
                yield _told(sent, parts, covered, open_)
                held, n = [], 0
        if held:
            sent, covered, open_ = rule(np.concatenate(held), False)
            yield _told(sent, parts, covered, open_)

    return run


def _owner(rule):
    def run(batches):
        blobs = [b for batch in batches for b in batch.column("blob").to_pylist()]
        if blobs:
            sent, covered, open_ = rule(np.frombuffer(b"".join(blobs), PLACE), True)
            yield _told(sent, 1, covered, open_)

    return run


def covered_spans(docs: DataFrame, *, window: int, scratch: Scratch) -> DataFrame:
    """(doc_id, spans): blobs of the windows of each document that start earlier elsewhere; some rows a document."""
    spark: SparkSession = docs.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))) * 2

    def find(batches):
        for ids, texts in _batches(batches):
            yield candidates(texts, ids, window)

    def again(places):
        def run(batches):
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                spans = [b"".join(x) for x in batch.column(2).to_pylist()]
                for first, some in chunks(texts):
                    yield places(some, ids[first : first + len(some)], spans[first : first + len(some)], window)

        return run

    covered = None
    rows = docs
    for name, rule, places in (("5", _first_level, find), ("10", _middle_level, again(extensions)), ("20", _last_level, again(windows))):
        sent = scratch.write(rows.mapInArrow(lean(_mapper(places, rule, parts)), KINDS), f"{name}-places")
        owned = sent.where("part is not null").select("part", "blob").repartition(parts, "part")
        owned = scratch.write(owned.mapInArrow(lean(_owner(rule)), KINDS), f"{name}-owned")
        told = sent.where("part is null").union(owned).select("doc_id", "spans", "open")
        more = told.where("not open").select("doc_id", "spans")
        covered = more if covered is None else covered.union(more)
        open_ = told.where("open")
        if not open_.limit(1).count():
            break
        rows = docs.join(open_.groupBy("doc_id").agg(F.collect_list("spans").alias("spans")), "doc_id").select("doc_id", "text", "spans")
    return covered


def _kept(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray) -> bytes:
    """Kept words joined by one blank."""
    s, e = starts[keep], ends[keep]
    if not len(s):
        return b""
    base, top = int(s[0]), int(e[-1]) + 1
    part = data[base:top].copy()
    edge = np.zeros(top - base + 1, np.int8)
    edge[s - base] += 1
    edge[e - base + 1] -= 1
    part[e - base] = 0x20
    return part[np.cumsum(edge[:-1]) > 0].tobytes()[:-1]


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 20, with_text: bool = False, scratch: Scratch | None = None
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, text]) of each row.

    A word goes if it lies in a window of ``window`` words (a multiple of 4)
    whose words stand earlier too: in a document of smaller id, or in the same
    one from an earlier word. Windows are judged on the input. Words are what
    stands between ASCII blanks, unchanged. Null, empty and short texts have no
    window and keep all words. Rows of one id are documents of their own, in an
    order among them that is fixed once, so of two equal rows one keeps its
    words; rows without an id stand after all others. Other columns are
    ignored. text: the words that stay, joined by one blank.
    """
    spark: SparkSession = docs.sparkSession
    scratch = scratch or Scratch(spark, "substring-dedup")
    if window % 4:
        raise ValueError("window must be a multiple of 4")
    one, names = own_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), scratch)
    covered = covered_spans(one, window=window, scratch=scratch).groupBy("doc_id").agg(F.collect_list("spans").alias("spans"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text

    def cut(batches):
        for batch in batches:
            ids = batch.column(0)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            spans = [b"".join(x) if x else b"" for x in batch.column(2).to_pylist()]
            words_, gone_, sha_, text_ = [], [], [], []
            for first, some in chunks(texts):
                w = textscan.words([t.encode() for t in some])
                for i, blob in enumerate(spans[first : first + len(some)]):
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    keep = np.ones(b - a, bool)
                    if blob:
                        sp = np.frombuffer(blob, SPAN)
                        edge = np.zeros(b - a + 1, np.int64)
                        np.add.at(edge, sp["start"], 1)
                        np.add.at(edge, sp["start"] + sp["run"] + window - 1, -1)
                        keep = np.cumsum(edge[:-1]) == 0
                    raw = _kept(w.data, w.starts[a:b], w.ends[a:b], keep)
                    words_.append(b - a)
                    gone_.append(b - a - int(keep.sum()))
                    sha_.append(hashlib.sha256(raw).hexdigest())
                    if with_text:
                        text_.append(raw.decode())
            columns = [ids, pa.array(words_, pa.int64()), pa.array(gone_, pa.int64()), pa.array(sha_, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(text_, pa.string())] * with_text], names=["doc_id", "n_words", "n_removed", "kept_sha256", *["text"] * with_text])

    return given_ids(one.join(covered, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(lean(cut), schema), names, "doc_id")


def op6_substring_dedup(spark, sf_dir):
    return substring_dedup(table(spark, sf_dir, "documents"))
