"""N-gram Jaccard join by vertical partitioning.

A document is the set of its distinct word shingles. All shingles have one
global order: first those that aren't known to be met often, from rare words to
common ones; then the others, by how often they are met. The order is cut into
fragments; for a pair of documents the overlap is counted in each
fragment separately and the counts are summed per pair.

Which pairs to count comes from the same order: two sets of Jaccard similarity
t or more share a shingle among the first ``n - ceil(t n) + 1`` of each. Those
prefixes go, by shingle, to owner tasks:

1. stars: of the documents of a shingle that are of like size, each is paired
   with one of them. A map task first does this among its own documents and
   passes on one document per shingle and size, so a shingle of a third of all
   documents is a few entries a task. Only shingles that have such a pair go on,
   and of these those that documents of different components share;
2. probes: of documents that are in other components after 1, the likeliest
   pair for each document and component;
3. all pairs whose ends are still in different components.

A shingle that very many documents have is split for 2 and 3: each two blocks of
its documents are a cell, and cells are dealt to the owner tasks like shingles.

Before a pair of 2 or 3 is a row, its owner task rules it out if the sizes, the
places in the order or the documents' sketches say so. A sketch holds, for each
of its bits, whether an odd number of the set's shingles fall on it; two
sketches differ in no more bits than the sets do in shingles, so no pair that
links is ruled out. Links found in 1 and 2 make 3 small: copies of one text are
one class from the start and near copies are one component after the first
steps, so neither is expanded into all pairs; yet no pair that could join two
components is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan
from .common import Scratch, components, given_ids, lean, own_rows, table

BROADCAST_IDS = 500_000


def _shingles(w: textscan.Words, size: int, weight: np.ndarray | None):
    """(hashes, owner, summed weights of their words) of the distinct shingles of each text, sorted by owner and hash."""
    count = np.diff(w.first)
    full = textscan.window_hashes(w.hashes, size)
    at = np.arange(len(full))
    owner = w.owner[: len(full)]
    inside = w.owner[at + size - 1] == owner if len(full) else np.zeros(0, bool)
    total = np.concatenate([[0], np.cumsum(weight if weight is not None else np.zeros(len(w.hashes), np.int64))])
    hashes, owners, weights = [full[inside]], [owner[inside]], [(total[at + size] - total[at])[inside] if len(full) else at]
    for n in range(1, size):  # fewer words: the whole sequence
        short = np.flatnonzero(count == n)
        if len(short):
            rows = w.hashes[w.first[short][:, None] + np.arange(n)]
            h = np.full(len(short), n, np.uint64)
            for k in range(n):
                h = textscan.mix64(h * np.uint64(0xC2B2AE3D27D4EB4F) + rows[:, k])
            hashes.append(h)
            owners.append(short)
            weights.append(total[w.first[short + 1]] - total[w.first[short]])
    h, o, c = np.concatenate(hashes), np.concatenate(owners).astype(np.int64), np.concatenate(weights)
    order = np.lexsort((h, o))
    h, o, c = h[order], o[order], c[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[new], o[new], c[new]


def shingle_sets(texts: list[str], size: int):
    """(hashes, owner): the distinct shingle hashes of each text, sorted within it."""
    return _shingles(textscan.words([t.encode() for t in texts], lower=True), size, None)[:2]


def _batches(batches, columns: int = 1):
    """(ids, texts) of about a million characters."""
    from . import bpe

    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        texts = [t or "" for t in batch.column(columns).to_pylist()]
        for first, part in bpe.chunks(texts, 700_000):
            yield ids[first : first + len(part)], part


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where a new value of the keys begins, in arrays sorted by them."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _stops(first: np.ndarray, n: int) -> np.ndarray:
    return np.append(first[1:], n)[: len(first)]


def _slices(first: np.ndarray, n: int):
    return zip(first.tolist(), _stops(first, n).tolist(), strict=True)


# -- sets: their identity and the shingles' order ---------------------------------------------------


#: words are counted in so many classes of their hash
WORD_BITS = 18
KEYS = "doc_id long, n long, k1 long, k2 long, kind int, h long, c long"
SHINGLE, WORD = 0, 1


def _set_keys(size: int):
    """Rows (doc_id, n, k1, k2), a document's set as its size and two hashes, and (kind, h, c), counts of shingles and classes of words met more than once here."""
    names = [f.split()[0] for f in KEYS.split(", ")]

    def run(batches):
        held, waiting = [], 0
        words = np.zeros(1 << WORD_BITS, np.int64)

        def counts(kind, h, c):
            h, c = h[c > 1], c[c > 1].astype(np.int64)
            none = pa.nulls(len(h), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(np.full(len(h), kind), pa.int32()), pa.array(h.view(np.int64)), pa.array(c)], names=names)

        def flush():
            h, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            held.clear()
            return counts(SHINGLE, h, c)

        for d, texts in _batches(batches):
            w = textscan.words([t.encode() for t in texts], lower=True)
            words += np.bincount((w.hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64), minlength=len(words))
            h, o, _ = _shingles(w, size, None)
            n = np.bincount(o, minlength=len(texts)).astype(np.int64)
            full = np.flatnonzero(n)
            k1, k2 = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
            if len(full):
                first = (np.cumsum(n) - n)[full]
                k1[full] = np.add.reduceat(h, first)
                k2[full] = np.add.reduceat(textscan.mix64(h ^ np.uint64(0x5851F42D4C957F2D)), first)
            none = pa.nulls(len(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(n), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.nulls(len(texts), pa.int32()), none, none], names=names)
            held.append(h)
            waiting += len(h)
            if waiting > 2_000_000:
                yield flush()
                waiting = 0
        yield flush()
        yield counts(WORD, np.arange(len(words)).astype(np.uint64), words)

    return run


class Order:
    """The global order of shingles; it decides what is compared first, never a result.

    known, often: shingles met in many documents, sorted by hash, and their
    counts; weight: of each class of words the binary logarithm of its count.
    """

    def __init__(self, known: np.ndarray, often: np.ndarray, weight: np.ndarray, shingle: int):
        self.known, self.often, self.weight, self.shingle = known, often, weight, shingle
        self.top = int(weight.max(initial=0)) * shingle + 1

    def sets(self, texts: list[str]):
        """(hashes, owner, rank) of the distinct shingles of each text; the order is by rank, then hash."""
        w = textscan.words([t.encode() for t in texts], lower=True)
        h, o, rank = _shingles(w, self.shingle, self.weight[(w.hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)])
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
            rank = np.where(self.known[at] == h, self.top + self.often[at], rank)
        return h, o, rank

    def fragment(self, rank: np.ndarray, fragments: int) -> np.ndarray:
        """Fragment of each shingle: equal stretches of the first part of the order, then those met often."""
        return np.minimum(rank, self.top) * (fragments - 1) // self.top


def global_order(counts: DataFrame, shingle: int, least: int, most: int) -> Order:
    """Order by counts (kind, h, c).

    Shingles met in about ``least`` documents or more are counted as what a
    task sees at least twice; at most ``most`` of them (16 bytes each), the most
    frequent, go to the driver and to the workers. Classes of words are
    2**WORD_BITS at most.
    """
    often = counts.where(f"kind = {SHINGLE}").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
    top = often.orderBy(F.desc("c"), "h").limit(most).toPandas()
    h = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    words = counts.where(f"kind = {WORD}").groupBy("h").agg(F.sum("c").alias("c")).toPandas()
    weight = np.zeros(1 << WORD_BITS, np.int64)
    weight[words["h"].to_numpy(np.int64)] = np.log2(words["c"].to_numpy(np.float64)).astype(np.int64)
    return Order(h[order], top["c"].to_numpy(np.int64)[order], weight, shingle)


# -- sketches ---------------------------------------------------------------------------------------


def sketches(h: np.ndarray, owner: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Of each set of n shingles the parities of how many fall on each bit: a power of two, 2 to 4 bits a shingle up to 256 shingles, then 1 to 2."""
    bits = np.maximum(128, (1 + (n <= 256)) << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    at = np.cumsum(bits) - bits
    place = at[owner] + ((h >> np.uint64(3)) & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    raw = np.packbits(np.bincount(place, minlength=int(bits.sum())).astype(np.uint8) & 1, bitorder="little").tobytes()
    return [raw[a // 8 : (a + b) // 8] for a, b in zip(at.tolist(), bits.tolist(), strict=True)]


class Sketches:
    """Sketches of several widths, to be compared by pairs."""

    def __init__(self, raw: list[bytes]):
        width = np.array([len(r) // 8 for r in raw], np.int64)
        self.width, self.row, self.held = width, np.zeros(len(raw), np.int64), {}
        for w in np.unique(width).tolist():
            here = np.flatnonzero(width == w)
            self.row[here] = np.arange(len(here))
            self.held[w] = np.frombuffer(b"".join([raw[i] for i in here.tolist()]), "<u8").reshape(len(here), w)

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits in which the pairs' sketches differ; the wider one is folded to the other's width."""
        out = np.zeros(len(a), np.int64)
        wa, wb = self.width[a], self.width[b]
        for code in np.unique(wa << 32 | wb).tolist():
            u, v = code >> 32, code & 0xFFFFFFFF
            which = np.flatnonzero((wa == u) & (wb == v))
            step = max(1, 1_000_000 // max(u, v))
            small = min(u, v)
            for s in range(0, len(which), step):
                some = which[s : s + step]
                x, y = self.held[u][self.row[a[some]]], self.held[v][self.row[b[some]]]
                x, y = (np.bitwise_xor.reduce(z.reshape(len(some), -1, small), axis=1) for z in (x, y))
                out[some] = np.bitwise_count(x ^ y).sum(1)
        return out


def most_apart(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Shingles by which two sets of n and m may differ if they link; negative if they can't."""
    least = -(-percent * (n + m) // (100 + percent))
    return np.where(least > np.minimum(n, m), -1, n + m - 2 * least)


# -- stars ------------------------------------------------------------------------------------------

ENTRY = np.dtype([("h", "<u8"), ("doc", "<i8"), ("n", "<i4"), ("pos", "<i4")])
MARK = np.dtype([("h", "<u8"), ("pos", "<i4")])
NEAR = np.uint64(1)
OWNED = "part int, blob binary, pairs binary, doc long, marks binary"
STARS = "a long, b long, n_a long, n_b long, shared long, doc long, marks binary"


def _entries(batch, percent: int) -> np.ndarray:
    """Prefix entries of a batch of (doc_id, n, prefix blob).

    Of two sets that link, the first shared shingle is near the front of the
    smaller one; the lowest bit of ``h`` tells whether an entry is.
    """
    blobs = batch.column("prefix").to_pylist()
    size = np.array([len(x) // 8 for x in blobs], np.int64)
    out = np.empty(int(size.sum()), ENTRY)
    out["doc"] = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), size)
    out["n"] = np.repeat(batch.column("n").to_numpy(zero_copy_only=False), size)
    out["pos"] = np.arange(len(out)) - np.repeat(np.cumsum(size) - size, size)
    near = (100 + percent) * out["pos"].astype(np.int64) <= (100 - percent) * out["n"].astype(np.int64)
    out["h"] = (np.frombuffer(b"".join(blobs), "<u8") & ~NEAR) | near.astype(np.uint64)
    return out


def stars(entries: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries that stand for the others elsewhere, rows (leader, document, their sizes, shingles they share here), entries that have a partner).

    Sizes are cut into classes so that two sets that link are in one class or
    in neighbouring ones. The leader of a shingle's class is, of the documents
    that have it near their front, the one with the fewest rarer shingles
    before it: of near copies, the one that was changed least. Those of a class
    without such a document have the leader of the class below.
    """
    key, far = entries["h"] | NEAR, (entries["h"] & NEAR) == 0
    kind = np.floor(np.log(np.maximum(entries["n"], 1)) / (np.log(100 / percent) + 1e-9)).astype(np.int64)
    order = np.lexsort((entries["doc"], entries["pos"], far, kind, key))
    entries, key, far, kind = entries[order], key[order], far[order], kind[order]
    first = _firsts(key, kind)
    size = np.diff(np.append(first, len(entries)))
    near = ~far[first]
    below = np.zeros(len(first), bool)  # the class below is there, with a leader
    below[1:] = (key[first][1:] == key[first][:-1]) & (kind[first][1:] == kind[first][:-1] + 1) & near[:-1]
    under = np.concatenate([[0], first[:-1]]) if len(first) else first
    lead = np.where(near, first, np.where(below, under, -1))
    leader = np.repeat(lead, size)
    member = np.flatnonzero((leader >= 0) & (leader != np.arange(len(entries))))
    both = near & below  # and the two leaders with each other
    x = np.concatenate([leader[member], under[both]])
    y = np.concatenate([member, first[both]])
    marked = np.zeros(len(entries), bool)
    marked[x] = marked[y] = True
    rows = np.stack([entries["doc"][x], entries["doc"][y], entries["n"][x], entries["n"][y]], 1).astype(np.int64)
    rows, shared = np.unique(rows, axis=0, return_counts=True)
    on = np.repeat(~near, size)  # without a near one a class may find its leader elsewhere: all go on
    on[first] = True
    return entries[on], np.concatenate([rows, shared[:, None]], 1).astype(np.int64), entries[marked]


def _columns(entries: np.ndarray) -> bytes:
    """The fields one after another; ids as differences, which compress."""
    return b"".join(np.diff(entries[f], prepend=entries[f].dtype.type(0)).tobytes() if f == "doc" else entries[f].tobytes() for f in entries.dtype.names)


def _read(blobs: list[bytes]) -> np.ndarray:
    out = np.zeros(sum(map(len, blobs)) // ENTRY.itemsize, ENTRY)
    row = 0
    for blob in blobs:
        n, at = len(blob) // ENTRY.itemsize, 0
        for f in ENTRY.names:
            part = np.frombuffer(blob, ENTRY[f], n, at)
            out[f][row : row + n] = np.cumsum(part) if f == "doc" else part
            at += n * ENTRY[f].itemsize
        row += n
    return out


def _parts(h: np.ndarray, parts: int) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) % parts


def _marks(entries: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(documents, blob of each one's marks)."""
    entries = entries[np.lexsort((entries["pos"], entries["doc"]))]
    out = np.empty(len(entries), MARK)
    out["h"], out["pos"] = entries["h"] | NEAR, entries["pos"]
    first = _firsts(entries["doc"])
    return entries["doc"][first], [out[a:b].tobytes() for a, b in _slices(first, len(out))]


def _star_map(parts: int, percent: int):
    def run(batches):
        held, waiting = [], 0

        def flush():
            on, pairs, marked = stars(np.concatenate(held) if held else np.zeros(0, ENTRY), percent)
            held.clear()
            part = _parts(on["h"], parts)
            order = np.lexsort((on["doc"], part))
            on, part = on[order], part[order]
            first = _firsts(part)
            blobs = [_columns(on[a:b]) for a, b in _slices(first, len(on))]
            spread = [pairs[k::parts].astype("<i8").tobytes() for k in range(parts) if k < len(pairs)]
            docs, marks = _marks(marked)
            k, p, d = len(blobs), len(spread), len(docs)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([part[first], np.arange(p), docs % parts]), pa.int32()),
                    pa.array([*blobs, *[None] * (p + d)], pa.binary()),
                    pa.array([*[None] * k, *spread, *[None] * d], pa.binary()),
                    pa.concat_arrays([pa.nulls(k + p, pa.int64()), pa.array(docs, pa.int64())]),
                    pa.array([*[None] * (k + p), *marks], pa.binary()),
                ],
                names=["part", "blob", "pairs", "doc", "marks"],
            )

        for batch in batches:
            held.append(_entries(batch, percent))
            waiting += len(held[-1])
            if waiting > 600_000:
                yield flush()
                waiting = 0
        yield flush()

    return run


def _star_owner(percent: int):
    def run(batches):
        blobs, pairs, waiting = [], [], 0

        def rows(pairs, docs, marks):
            p, d = len(pairs), len(docs)
            columns = [pa.concat_arrays([pa.array(pairs[:, k], pa.int64()), pa.nulls(d, pa.int64())]) for k in range(5)]
            columns += [pa.concat_arrays([pa.nulls(p, pa.int64()), pa.array(docs, pa.int64())]), pa.array([*[None] * p, *marks], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b", "n_a", "n_b", "shared", "doc", "marks"])

        none = np.zeros((0, 5), np.int64)
        for batch in batches:
            blobs += [b for b in batch.column("blob").to_pylist() if b]
            pairs += [np.frombuffer(b, "<i8").reshape(-1, 5) for b in batch.column("pairs").to_pylist() if b]  # what the map tasks found
            passed = batch.filter(batch.column("doc").is_valid())
            if passed.num_rows:
                yield rows(none, passed.column("doc").to_numpy(), passed.column("marks").to_pylist())
        if blobs:
            _, found, marked = stars(_read(blobs), percent)
            pairs.append(found)
            yield rows(none, *_marks(marked))
        if pairs:
            every = np.concatenate(pairs)
            keys, which = np.unique(every[:, :4], axis=0, return_inverse=True)
            yield rows(np.concatenate([keys, np.bincount(which.ravel(), weights=every[:, 4]).astype(np.int64)[:, None]], 1), np.zeros(0, np.int64), [])

    return run


# -- shingles of very many documents ----------------------------------------------------------------


def _mark_counts(batches):
    """(h, n): how many documents of a batch have each shingle in their marks."""
    for batch in batches:
        marks = [np.unique(np.frombuffer(b"".join(m), MARK))["h"] for m in batch.column("marks").to_pylist()]
        h, n = np.unique(np.concatenate(marks) if marks else np.zeros(0, np.uint64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["h", "n"])


def split_marks(hot: np.ndarray, blocks: np.ndarray):
    """Documents (doc_id, n, marks) with the marks of hot shingles (sorted) under cells in their place.

    A hot shingle's documents are dealt to blocks by hash, and each pair of
    blocks is a cell, a shingle of its own to the owner tasks; a document goes
    to the cells of its block. So every two documents of the shingle meet in a
    cell, and no cell has more than two blocks of them, whatever task it is in.
    """

    def run(batches):
        for batch in batches:
            out = []
            for doc, lists in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                marks = np.unique(np.frombuffer(b"".join(lists), MARK))
                at = np.minimum(np.searchsorted(hot, marks["h"]), max(0, len(hot) - 1))
                split = hot[at] == marks["h"] if len(hot) else np.zeros(len(marks), bool)
                if split.any():
                    k = blocks[at[split]]
                    cell = np.repeat(marks[split], k)
                    every = np.repeat(k, k).astype(np.uint64)
                    own = textscan.mix64(cell["h"] ^ textscan.mix64(np.full(len(cell), doc).astype(np.uint64))) % every
                    other = (np.arange(len(cell)) - np.repeat(np.cumsum(k) - k, k)).astype(np.uint64)
                    low, high = np.minimum(own, other), np.maximum(own, other)
                    cell["h"] = textscan.mix64(cell["h"] + textscan.mix64(low * np.uint64(0x9E3779B97F4A7C15) + high + np.uint64(1))) | NEAR
                    marks = np.concatenate([marks[~split], cell])
                out.append([marks.tobytes()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.binary()))], names=["doc_id", "n", "marks"])

    return run


def _split_hot(rows: DataFrame, split_from: int) -> DataFrame:
    """rows (doc_id, n, marks) with shingles of more than ``split_from`` documents split into cells.

    At most some 500,000 shingles (16 bytes each) are told to the tasks: where
    there are more of that size, those of the most documents are.
    """
    counts = rows.mapInArrow(lean(_mark_counts), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > split_from)
    told = counts.orderBy(F.desc("n"), "h").limit(500_000).toArrow().sort_by("h")
    hot = told["h"].to_numpy().view(np.uint64)
    order = np.argsort(hot)
    blocks = -(-told["n"].to_numpy() // split_from)[order]
    given = rows.sparkSession.sparkContext.broadcast((hot[order], blocks.astype(np.int64)))

    def run(batches):
        yield from split_marks(*given.value)(batches)

    return rows.mapInArrow(lean(run), "doc_id long, n long, marks array<binary>")


# -- probes and all pairs across components ---------------------------------------------------------

CROSSED = "part int, blob binary"
PARTNER = np.dtype([("doc", "<i8"), ("n", "<i8"), ("comp", "<i8"), ("apart", "<i8")])
PARTNERS = "a long, n_a long, chunk long, partners binary"
PAIRS = "a long, b long, n_a long, n_b long"


def _cross_map(parts: int):
    """Blobs by part: the documents that have entries there, each once with its sketch if there is one, and the entries."""

    def run(batches):
        for batch in batches:
            docs, n, comp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "n", "component"))
            sketch = batch.column("sketch").to_pylist() if "sketch" in batch.schema.names else [b""] * len(docs)
            marks = [np.unique(np.frombuffer(b"".join(m), MARK)) for m in batch.column("marks").to_pylist()]
            row = np.repeat(np.arange(len(docs)), [len(m) for m in marks])
            entry = np.concatenate(marks) if marks else np.zeros(0, MARK)
            part = _parts(entry["h"], parts)
            order = np.lexsort((row, part))
            part, row, entry = part[order], row[order], entry[order]
            first = _firsts(part)
            blobs = []
            for a, b in _slices(first, len(part)):
                own, at = np.unique(row[a:b], return_inverse=True)
                raw = [sketch[i] for i in own.tolist()]
                size = np.array([len(r) for r in raw], "<i4")
                head = np.array([len(own), b - a], "<i8")
                fields = (head, docs[own].astype("<i8"), n[own].astype("<i8"), comp[own].astype("<i8"), size)
                blobs.append(b"".join([*(x.tobytes() for x in fields), *raw, entry["h"][a:b].tobytes(), at.astype("<i4").tobytes(), entry["pos"][a:b].tobytes()]))
            yield pa.RecordBatch.from_arrays([pa.array(part[first], pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])

    return run


def _uncross(blobs: list[bytes]):
    """(docs, n, comp, sketches, h, row, pos) of blobs by :func:`_cross_map`."""
    docs, n, comp, sketch, h, row, pos, base = [], [], [], [], [], [], [], 0
    for blob in blobs:
        k, e = np.frombuffer(blob, "<i8", 2).tolist()
        at = 16
        for out in (docs, n, comp):
            out.append(np.frombuffer(blob, "<i8", k, at))
            at += 8 * k
        size = np.frombuffer(blob, "<i4", k, at).tolist()
        at += 4 * k
        for s in size:
            sketch.append(blob[at : at + s])
            at += s
        h.append(np.frombuffer(blob, "<u8", e, at))
        row.append(np.frombuffer(blob, "<i4", e, at + 8 * e).astype(np.int64) + base)
        pos.append(np.frombuffer(blob, "<i4", e, at + 12 * e).astype(np.int64))
        base += k
    return *map(np.concatenate, (docs, n, comp)), Sketches(sketch), *map(np.concatenate, (h, row, pos))


def able_pairs(n, comp, h, row, pos, percent: int, most: int = 300_000):
    """Yields arrays (i, j) of entries of a shingle whose documents, in different components, link for all that sizes and places tell; j is of the larger component of the shingle.

    Of a shingle's documents those of its largest component are met by all
    others, and the others by each other; so a component of any size costs what
    stands beside it, not its square. About ``most`` pairs at a time.
    """
    order = np.lexsort((comp[row], h))
    c = comp[row[order]]
    run = _firsts(h[order], c)
    size = np.diff(np.append(run, len(h)))
    large = np.zeros(len(run), bool)
    shingle = h[order][run]
    by_size = np.lexsort((-size, shingle))
    large[by_size[_firsts(shingle[by_size])]] = True
    beside = ~np.repeat(large, size)
    again = np.lexsort((c, beside, h[order]))
    order, beside = order[again], beside[again]
    start = np.zeros(len(h), np.int64)
    first = _firsts(h[order])
    start[first] = first
    start = np.maximum.accumulate(start) if len(h) else start
    rest = np.flatnonzero(beside)
    before = rest - start[rest]
    done = np.cumsum(before)
    a = 0
    while a < len(rest):
        b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + most, side="right")))
        k = before[a:b]
        i = np.repeat(rest[a:b], k)
        j = order[np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k) + start[i]]
        i = order[i]
        a = b
        x, y = row[i], row[j]
        # If this is the first shared shingle, those before it are in one set only, and no more than the rest of both can be shared.
        shared = 1 + np.minimum(n[x] - 1 - pos[i], n[y] - 1 - pos[j])
        able = (comp[x] != comp[y]) & ((100 + percent) * shared >= percent * (n[x] + n[y])) & (pos[i] + pos[j] <= most_apart(n[x], n[y], percent))
        yield i[able], j[able]


def candidate_pairs(n, comp, sketch: Sketches, h, row, pos, percent: int):
    """Yields arrays (x, y, bits apart) of documents that may link by their sketches too, each pair once in a batch."""
    for i, j in able_pairs(n, comp, h, row, pos, percent):
        key = np.unique(row[i] * len(n) + row[j])
        x, y = key // len(n), key % len(n)
        apart = sketch.differ(x, y)
        near = apart <= most_apart(n[x], n[y], percent)
        if near.any():
            yield x[near], y[near], apart[near]


def _mixed_owner(percent: int):
    """Rows (doc, marks): the entries that are in a pair of :func:`able_pairs`."""

    def run(batches):
        blobs = [b for batch in batches for b in batch.column("blob").to_pylist()]
        if blobs:
            docs, n, comp, _, h, row, pos = _uncross(blobs)
            able = np.zeros(len(h), bool)
            for i, j in able_pairs(n, comp, h, row, pos, percent):
                able[i] = able[j] = True
            entries = np.zeros(int(able.sum()), ENTRY)
            entries["h"], entries["doc"], entries["pos"] = h[able], docs[row[able]], pos[able]
            ids, marks = _marks(entries)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.binary())], names=["doc", "marks"])

    return run


def _likeliest(a, comp, apart, b) -> np.ndarray:
    """Of rows of each (a, comp) the one least apart."""
    order = np.lexsort((b, apart, comp, a))
    return order[_firsts(a[order], comp[order])]


def _cross_owner(percent: int, probe: bool):
    """probe: for each document and other component the likeliest partner only."""

    def run(batches):
        blobs = [b for batch in batches for b in batch.column("blob").to_pylist()]
        if not blobs:
            return
        docs, n, comp, sketch, h, row, pos = _uncross(blobs)
        found: list[tuple] = []
        waiting = 0

        def thin():
            x, y, apart = map(np.concatenate, zip(*found, strict=True))
            if probe:
                keep = _likeliest(x, comp[y], apart, y)
            else:
                x, y = np.minimum(x, y), np.maximum(x, y)
                keep = np.unique(x * len(docs) + y, return_index=True)[1]
            found[:] = [(x[keep], y[keep], apart[keep])]
            return len(keep)

        def rows():
            x, y, apart = found.pop()
            if not probe:
                swap = docs[x] > docs[y]
                x, y = np.where(swap, y, x), np.where(swap, x, y)
            chunk = np.zeros(len(x), np.int64) if probe else docs[y] >> 16
            order = np.lexsort((docs[y], chunk, x))
            x, y, apart, chunk = x[order], y[order], apart[order], chunk[order]
            partner = np.empty(len(x), PARTNER)
            partner["doc"], partner["n"], partner["comp"], partner["apart"] = docs[y], n[y], comp[y], apart
            first = _firsts(x, chunk)
            blobs = [partner[a:b].tobytes() for a, b in _slices(first, len(x))]
            columns = [pa.array(docs[x[first]], pa.int64()), pa.array(n[x[first]], pa.int64()), pa.array(chunk[first], pa.int64()), pa.array(blobs, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["a", "n_a", "chunk", "partners"])

        for some in candidate_pairs(n, comp, sketch, h, row, pos, percent):
            found.append(some)
            waiting += len(some[0])
            if waiting > 500_000:
                waiting = thin()
                if waiting > 300_000:
                    yield rows()
                    waiting = 0
        if found:
            thin()
            yield rows()

    return run


def _merged(probe: bool):
    """PAIRS of (a, n_a, lists of partners): each pair once; probe: one for each component."""

    def run(batches):
        for batch in batches:
            a, n_a, b, n_b = [], [], [], []
            for doc, n, lists in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                p = np.frombuffer(b"".join(lists), PARTNER)
                p = p[_likeliest(np.zeros(len(p), np.int64), p["comp"] if probe else p["doc"], p["apart"], p["doc"])]
                a.append(np.full(len(p), doc))
                n_a.append(np.full(len(p), n))
                b.append(p["doc"])
                n_b.append(p["n"])
            if a:
                columns = [pa.array(np.concatenate(x), pa.int64()) for x in (a, b, n_a, n_b)]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "n_a", "n_b"])

    return run


# -- overlaps ---------------------------------------------------------------------------------------


def _few(ids: DataFrame) -> DataFrame:
    """Marked for broadcast if there are few (some longs each)."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def _apart_in_sketch(percent: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sketch = Sketches([*batch.column("sketch_a").to_pylist(), *batch.column("sketch_b").to_pylist()])
                k = batch.num_rows
                n, m = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
                near = sketch.differ(np.arange(k), np.arange(k, 2 * k)) <= most_apart(n, m, percent)
                yield batch.select(["a", "b", "n_a", "n_b"]).filter(pa.array(near))

    return run


def partial_overlaps(docs: DataFrame, pairs: DataFrame, fragments: int, order) -> DataFrame:
    """(a, b, n_a, n_b, overlap) of pairs of documents: the overlap is counted in each fragment of the order, then summed.

    order: broadcast of the :class:`Order`.
    """
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()

    def cut(batches):
        for d, texts in _batches(batches):
            h, o, rank = order.value.sets(texts)
            f = order.value.fragment(rank, fragments)
            by = np.lexsort((h, f, o))
            h, o, f = h[by], o[by], f[by]
            first = _firsts(o, f)
            offsets = np.append(first, len(h)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(d[o[first]]), pa.array(f[first].astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.view(np.int64)))],
                names=["doc_id", "fragment", "part"],
            )

    segments = docs.join(_few(ids), "doc_id", "left_semi").mapInArrow(lean(cut), "doc_id long, fragment int, part array<long>")
    wide = pairs.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(fragments - 1))))
    left = wide.join(segments.select(F.col("doc_id").alias("a"), "fragment", F.col("part").alias("x")), ["a", "fragment"])
    both = left.join(segments.select(F.col("doc_id").alias("b"), "fragment", F.col("part").alias("y")), ["b", "fragment"])
    return both.groupBy("a", "b", "n_a", "n_b").agg(F.sum(F.size(F.array_intersect("x", "y"))).alias("overlap"))


def jaccard_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    shingle: int = 5,
    percent: int = 80,
    fragments: int = 3,
    frequent_from: int = 12,
    frequent_most: int = 500_000,
    split_from: int = 2048,
    scratch: Scratch | None = None,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row.

    Words are what stands between ASCII blanks, A-Z in lower case. Documents
    link when 100 * intersection >= percent * union. Those of fewer words than
    a shingle are one shingle of all their words; null, empty and blank texts
    are empty sets and link with nothing, not even with each other.
    component_id: the smallest id reachable by links. Rows of one id are
    documents of their own, and so are rows without one, which stand after all
    others (a component of such rows alone has a null id). Other columns are
    ignored. fragments: 1 or more. split_from: a shingle of more documents that
    still are in pairs goes to several owner tasks.
    """
    spark: SparkSession = docs.sparkSession
    scratch = scratch or Scratch(spark, "jaccard-join")
    one, names = own_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), scratch)
    return given_ids(_joined(one, shingle, percent, fragments, frequent_from, frequent_most, split_from, scratch), names, "doc_id", "component_id")


def _joined(one: DataFrame, shingle: int, percent: int, fragments: int, frequent_from: int, frequent_most: int, split_from: int, scratch: Scratch) -> DataFrame:
    """jaccard_join of (doc_id, text) with ids that are unique."""
    spark = one.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))) * 2
    keys = scratch.write(one.mapInArrow(lean(_set_keys(shingle)), KEYS), "keys")
    order = spark.sparkContext.broadcast(global_order(keys.where("h is not null").select("kind", "h", "c"), shingle, frequent_from, frequent_most))
    rows = keys.where("n is not null").select("doc_id", "n", "k1", "k2")
    classes = rows.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = scratch.write(classes.where("copies > 1").drop("copies"), "classes")
    member = rows.join(_few(classes), ["n", "k1", "k2"], "left").select("doc_id", "n", F.coalesce("first", "doc_id").alias("class"))
    member = scratch.write(member, "member")
    scratch.drop("keys", "classes")

    def prefixes(batches):
        for d, texts in _batches(batches):
            h, o, rank = order.value.sets(texts)
            n = np.bincount(o, minlength=len(texts)).astype(np.int64)
            first = np.cumsum(n) - n
            ordered = h[np.lexsort((h, rank, o))]
            take = np.where(n > 0, n - -(-percent * n // 100) + 1, 0)
            blobs = [ordered[s : s + t].tobytes() for s, t in zip(first.tolist(), take.tolist(), strict=True)]
            batch = [pa.array(d, pa.int64()), pa.array(n), pa.array(blobs, pa.binary()), pa.array(sketches(h, o, n), pa.binary())]
            yield pa.RecordBatch.from_arrays(batch, names=["doc_id", "n", "prefix", "sketch"]).filter(pa.array(n > 0))

    others = member.where("class <> doc_id").select("doc_id")
    chosen = one.mapInArrow(lean(prefixes), "doc_id long, n long, prefix binary, sketch binary").join(_few(others), "doc_id", "left_anti")
    chosen = scratch.write(chosen, "chosen")

    def links(pairs: DataFrame, name: str) -> DataFrame:
        counted = partial_overlaps(one, scratch.write(pairs, f"{name}-pairs"), fragments, order)
        out = scratch.write(counted.where((100 + percent) * F.col("overlap") >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b"), f"{name}-links")
        scratch.drop(f"{name}-pairs")
        return out

    def owned(mapped: DataFrame, owner, schema: str) -> DataFrame:
        return mapped.repartition(parts, "part").mapInArrow(lean(owner), schema)

    # Each document with the leader that it shares most prefix shingles with.
    met = owned(chosen.select("doc_id", "n", "prefix").mapInArrow(lean(_star_map(parts, percent)), OWNED), _star_owner(percent), STARS)
    met = scratch.write(met, "stars")
    pairs = met.where("a is not null").groupBy("a", "b", "n_a", "n_b").agg(F.sum("shared").alias("shared"))
    best = pairs.groupBy("b", "n_b").agg(F.max_by(F.struct("a", "n_a"), F.struct("shared", -F.col("a"))).alias("best"))
    of = lambda c: chosen.select(F.col("doc_id").alias(c), F.col("sketch").alias(f"sketch_{c}"))
    led = best.select(F.col("best.a").alias("a"), "b", F.col("best.n_a").alias("n_a"), "n_b").join(of("a"), "a").join(of("b"), "b")
    found = links(led.mapInArrow(lean(_apart_in_sketch(percent)), PAIRS), "star")
    joined = components(scratch, found)

    def marked(rows: DataFrame) -> DataFrame:
        return rows.where("doc is not null").groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("marks").alias("marks"))

    def crossed(rows: DataFrame, owner, schema: str) -> DataFrame:
        """What owner makes of documents (doc_id, n, marks, sketch if there is one) under their components."""
        rows = rows.join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        return owned(rows.mapInArrow(lean(_cross_map(parts)), CROSSED), owner, schema)

    # Only shingles that documents of different components share go on, and only their documents need sketches.
    met = scratch.write(marked(met).join(chosen.select("doc_id", "n"), "doc_id").select("doc_id", "n", "marks"), "met")
    mixed = crossed(_split_hot(met, split_from), _mixed_owner(percent), "doc long, marks binary")
    mixed = scratch.write(mixed, "mixed")
    shared = scratch.write(marked(mixed).join(chosen.select("doc_id", "n", "sketch"), "doc_id"), "shared")
    scratch.drop("stars", "met", "chosen", "mixed")
    for name in ("probe", "cross"):
        probe = name == "probe"
        lists = crossed(shared, _cross_owner(percent, probe), PARTNERS)
        lists = lists.groupBy("a", "n_a", "chunk").agg(F.collect_list("partners").alias("partners")).select("a", "n_a", "partners")  # 65536 ids a chunk
        found = scratch.write(found.union(links(lists.mapInArrow(lean(_merged(probe)), PAIRS), name)), f"{name}-found")
        joined = components(scratch, found)
    out = member.join(joined.select(F.col("node").alias("class"), "component"), "class", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "class").alias("component_id"))
    scratch.drop("shared", "star-links", "probe-links", "probe-found", "cross-links", "cross-found")
    return out


def op9_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join(table(spark, sf_dir, "documents"))
