"""Embedding near-dedup on a robust-pruned flat graph.

1. Equal vectors are one class; only a class's first vector goes on. Vectors of
   each length are compared with each other.
2. Vectors go to the nearest of their cluster centres: overlapping shards. Two
   vectors that link share a centre whose cell is within half the angle of a
   link of both, so farther centres are left out. Centres are fitted in several
   numbers and thinned where they crowd; of those that keep the links of a
   sample together the ones that cost least are taken. A shard above the block
   size is dealt into blocks.
3. Each block builds a flat graph: its vectors are dealt into small overlapping
   clusters, which give each node its candidates, and some far nodes; candidates
   are pruned robustly (one goes if one that is kept is nearer to it by a
   factor), links are made to go both ways, and what the medoids don't reach is
   tied in.
4. The adjacency lists of all blocks are united per vector.
5. Every vector is a query in its shards, against each block: a greedy beam
   search from the block's medoids, then the range expands from what is near
   enough, along the graph, until it grows no more. A check of some queries
   against all of the block audits the search; where it is short, it runs again
   with a wider beam.
6. Each pair found is verified by its cosine in double precision and counted in
   the first shard that holds both. A task returns sums and one edge for each
   vector that it joins to others, never pairs.
7. A stated set of queries is held against all vectors, in blocks. Where the
   links found for them fall short of the recall asked for, vectors go to twice
   as many centres and 2 to 6 run again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, given_ids, lean, own_rows, table

TARGET_RECALL = 0.99
#: cosines in single precision are off by less
SLACK = 1e-4


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1, in double precision; huge and tiny components are scaled first."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


# -- shards -----------------------------------------------------------------------------------------


def fit_centres(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on a sample of unit vectors."""
    centres = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        home = np.argmax(sample @ centres.T, 1)
        order = np.argsort(home, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], home[order][1:] != home[order][:-1]]))
        centres[home[order][first]] = np.add.reduceat(sample[order], first, axis=0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def shards_of(vectors: np.ndarray, centres: np.ndarray, least: float, overlap: int) -> np.ndarray:
    """(n, overlap) nearest centres of unit vectors, nearest first; -1 where fewer can matter.

    A vector within an angle t of a point of c's cell is no more than sin(t)
    beyond the plane between c and its own nearest centre, so a centre farther
    than that, t half the angle of a link, holds no middle of two linked ones.
    """
    near = vectors @ centres.T
    overlap = min(overlap, len(centres))
    top = np.argpartition(-near, overlap - 1, axis=1)[:, :overlap]
    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)
    home = top[:, :1]
    gaps = np.sqrt(np.maximum(2 - 2 * (centres[home] * centres[top]).sum(2), 0))
    reach = np.sin(np.arccos(least) / 2) * gaps + 1e-6  # above all rounding
    return np.where(np.take_along_axis(near, home, 1) - np.take_along_axis(near, top, 1) <= reach, top, -1)


def thinned(centres: np.ndarray, angle: float) -> np.ndarray:
    """The centres without those within ``angle`` degrees of one before them."""
    alike = centres @ centres.T >= np.cos(np.radians(angle))
    alive = np.ones(len(centres), bool)
    for c in range(len(centres)):
        if alive[c]:
            alive[c + 1 :] &= ~alike[c, c + 1 :]
    return centres[alive]


def choose_centres(sample: np.ndarray, n: int, block: int, k: int, least: float, overlap: int) -> np.ndarray:
    """Of centres in several numbers and thinnings those by which n vectors are searched at the least cost, among those that keep the sample's links together.

    A dense group that many centres cut would lose links; with thinned centres
    it is one shard, dealt into blocks.
    """
    few = sample[:: max(1, len(sample) // 4000)]
    a, b = np.nonzero(np.triu(few @ few.T >= least, 1))
    a, b = a[:: len(a) // 200_000 + 1], b[:: len(b) // 200_000 + 1]
    best, least_cost = None, np.inf
    while True:
        fitted = fit_centres(sample, k)
        tried = set()
        for angle in (0, 10, 20, 30, 45):
            centres = thinned(fitted, angle) if angle else fitted
            if len(centres) in tried:
                continue
            tried.add(len(centres))
            homes = shards_of(few, centres, least, overlap)
            kept = ((homes[a][:, :, None] == homes[b][:, None, :]) & (homes[a] >= 0)[:, :, None]).any((1, 2))
            rows = np.bincount(homes[homes >= 0], minlength=len(centres)) * (n / len(few))
            cost = (rows * (np.ceil(rows / block) + 3) / 2).sum()
            if cost < least_cost and (not len(kept) or kept.mean() >= TARGET_RECALL):
                best, least_cost = centres, cost
        if k == 1:
            return best
        k = max(1, k // 4)


# -- graph ------------------------------------------------------------------------------------------


def medoids(x: np.ndarray, most: int = 8) -> np.ndarray:
    """The vector nearest to the mean, then those farthest from the ones taken."""
    mean = x.mean(0)
    taken = [int(np.argmax(x @ mean))]
    near = x @ x[taken[0]]
    while len(taken) < min(most, len(x)):
        taken.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[taken[-1]])
    return np.unique(taken)


def cluster_candidates(x: np.ndarray, near: int, leaf: int, overlap: int, rng) -> np.ndarray:
    """(n, overlap * near) nearest others of each vector in the small clusters that it is in; -1 where there are fewer."""
    n = len(x)
    out = np.full((n, overlap * near), -1, np.int64)
    k = max(1, 2 * n // leaf)
    overlap = min(overlap, k)
    centres = x[rng.permutation(n)[:k]]
    homes = np.argpartition(-(x @ centres.T), overlap - 1, axis=1)[:, :overlap]
    for c in range(k):
        member, slot = np.nonzero(homes == c)
        mixed = rng.permutation(len(member))
        for a in range(0, len(mixed), 2 * leaf):  # a crowded cluster is cut at random
            own = mixed[a : a + 2 * leaf]
            who, where = member[own], slot[own]
            m = min(near, len(who) - 1)
            if m > 0:
                sims = x[who] @ x[who].T
                np.fill_diagonal(sims, -3)
                top = np.argpartition(-sims, m - 1, axis=1)[:, :m]
                out[who[:, None], where[:, None] * near + np.arange(m)] = who[top]
    return out


def build_graph(x: np.ndarray, *, degree: int = 20, near: int = 16, far: int = 8, alpha: float = 1.2, leaf: int = 128, overlap: int = 3) -> list[np.ndarray]:
    """Adjacency lists of a flat graph over unit vectors."""
    n = len(x)
    if n == 1:
        return [np.zeros(0, np.int64)]
    rng = np.random.default_rng(7)
    every = np.concatenate([cluster_candidates(x, near, leaf, overlap, rng), rng.integers(0, n, (n, far))], 1)
    every.sort(axis=1)
    every[:, 1:][every[:, 1:] == every[:, :-1]] = -1  # each candidate once
    out = np.full((n, degree), -1, np.int64)
    step = max(1, 2_000_000 // (every.shape[1] * x.shape[1]))
    for a in range(0, n, step):
        own = np.arange(a, min(a + step, n))
        cand = every[own]
        dist = np.maximum(2 - 2 * np.matmul(x[cand], x[own][:, :, None])[:, :, 0], 0)  # squared chords
        alive = (cand >= 0) & (cand != own[:, None])
        order = np.argsort(np.where(alive, dist, 9), axis=1, kind="stable")
        cand, dist, alive = (np.take_along_axis(z, order, 1) for z in (cand, dist, alive))
        between = np.maximum(2 - 2 * np.matmul(x[cand], x[cand].transpose(0, 2, 1)), 0)
        row = np.arange(len(own))
        for r in range(degree):
            first = np.argmax(alive, axis=1)
            has = alive[row, first]
            if not has.any():
                break
            out[own[has], r] = cand[row[has], first[has]]
            alive[row, first] = False
            alive &= ~(has[:, None] & (alpha * alpha * between[row, first] <= dist))
    source = np.repeat(np.arange(n), degree)
    target = out.ravel()
    source, target = source[target >= 0], target[target >= 0]
    edges = np.unique(np.concatenate([source * n + target, target * n + source]))
    graph = np.split(edges % n, np.searchsorted(edges // n, np.arange(1, n)))
    return _reachable(x, graph, medoids(x))


def _reachable(x: np.ndarray, graph: list[np.ndarray], roots: np.ndarray) -> list[np.ndarray]:
    """The graph with edges from reached nodes to nearest ones that the roots don't reach."""
    seen = np.zeros(len(x), bool)

    def spread(front):
        seen[front] = True
        while len(front):
            nxt = np.unique(np.concatenate([graph[i] for i in front]))
            front = nxt[~seen[nxt]]
            seen[front] = True

    spread(np.asarray(roots))
    while not seen.all():
        lost = int(np.flatnonzero(~seen)[0])
        reached = np.flatnonzero(seen)
        by = int(reached[np.argmax(x[reached] @ x[lost])])
        graph[by] = np.append(graph[by], lost)
        graph[lost] = np.append(graph[lost], by)
        spread(np.array([lost]))
    return graph


# -- search -----------------------------------------------------------------------------------------


def _padded(graph: list[np.ndarray]) -> np.ndarray:
    size = np.array([len(g) for g in graph])
    out = np.full((len(graph), max(1, int(size.max()))), -1, np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = np.concatenate(graph)
    return out


def range_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, least: float, own: np.ndarray | None, beam: int, chunk: int = 1024) -> np.ndarray:
    """(queries, nodes) which nodes of cosine >= least the search meets; own: the queries' nodes, if they are in the graph."""
    roots = medoids(x)
    parts = [_searched(x, graph, queries[a : a + chunk], least, None if own is None else own[a : a + chunk], beam, roots) for a in range(0, len(queries), chunk)]
    return np.concatenate(parts) if parts else np.zeros((0, len(x)), bool)


def _searched(x, graph, queries, least, own, beam, roots) -> np.ndarray:
    nq, n = len(queries), len(x)
    seen = np.zeros((nq, n), bool)
    hit = np.zeros((nq, n), bool)
    ids = np.full((nq, beam), -1, np.int64)
    sims = np.full((nq, beam), -2.0, x.dtype)
    done = np.ones((nq, beam), bool)
    start = queries @ x[roots].T
    take = min(beam, len(roots))
    order = np.argsort(-start, axis=1)[:, :take]
    ids[:, :take], sims[:, :take], done[:, :take] = roots[order], np.take_along_axis(start, order, 1), False
    seen[:, roots] = True
    hit[:, roots] = start >= least
    width = graph.shape[1]
    while True:
        open_ = np.where(done, -3.0, sims)
        best = np.argmax(open_, axis=1)
        q = np.flatnonzero(open_[np.arange(nq), best] > -2)
        if not len(q):
            break
        done[q, best[q]] = True
        around = graph[ids[q, best[q]]]
        fresh = (around >= 0) & ~seen[q[:, None], around]
        qa, ka = np.nonzero(fresh)
        node = around[qa, ka]
        seen[q[qa], node] = True
        s = np.einsum("ij,ij->i", x[node], queries[q[qa]])
        hit[q[qa], node] = s >= least
        new_s = np.full((len(q), width), -2.0, x.dtype)
        new_s[qa, ka] = s
        all_s = np.concatenate([sims[q], new_s], 1)
        all_i = np.concatenate([ids[q], around], 1)
        all_d = np.concatenate([done[q], ~fresh], 1)
        top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        ids[q], sims[q], done[q] = np.take_along_axis(all_i, top, 1), np.take_along_axis(all_s, top, 1), np.take_along_axis(all_d, top, 1)
    if own is not None:
        seen[np.arange(nq), own] = True
        hit[np.arange(nq), own] = True
    fq, fn = np.nonzero(hit)
    while len(fq):  # the range expands from every hit
        nq_, nn_ = [], []
        for a in range(0, len(fq), 100_000):
            q, around = fq[a : a + 100_000], graph[fn[a : a + 100_000]]
            qa, ka = np.nonzero((around >= 0) & ~seen[q[:, None], around])
            key = np.unique(q[qa] * n + around[qa, ka])
            q, node = key // n, key % n
            seen[q, node] = True
            good = np.einsum("ij,ij->i", x[node], queries[q]) >= least
            q, node = q[good], node[good]
            hit[q, node] = True
            nq_.append(q)
            nn_.append(node)
        fq, fn = np.concatenate(nq_), np.concatenate(nn_)
    return hit


def audited_search(x, graph, queries, least, own, query_ids, beam: int = 16) -> np.ndarray:
    """range_search, run again with a wider beam while some of the queries miss too much: those of ids divisible by 50, or each 50th where there are none."""
    check = np.flatnonzero(query_ids % 50 == 0)
    if not len(check):
        check = np.arange(0, len(query_ids), 50)
    truth = queries[check] @ x.T >= least
    total = int(truth.sum())
    while True:
        hit = range_search(x, graph, queries, least, own, beam)
        if (hit[check] & truth).sum() >= TARGET_RECALL * total or beam >= len(x):
            return hit
        beam *= 2


def joined_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest place reachable) when the edges (a, b) are added to what labels say."""
    while True:
        low, high = np.minimum(labels[a], labels[b]), np.maximum(labels[a], labels[b])
        if (low == high).all():
            return labels
        np.minimum.at(labels, high, low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), -1)


def _homes(column) -> np.ndarray:
    """(n, overlap) shards of each vector in rising order; greatest where there are fewer."""
    rows = [np.sort(np.frombuffer(h, "<i8")) for h in column.to_pylist()]
    out = np.full((len(rows), max(map(len, rows), default=1)), 2**62, np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def first_common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest shard that is in both of each two rows of homes."""
    out = np.full(len(x), 2**62, np.int64)
    for k in range(x.shape[1]):
        out = np.minimum(out, np.where((x[:, k : k + 1] == y).any(1), x[:, k], 2**62))
    return out


# -- Spark ------------------------------------------------------------------------------------------

MEMBER = "shard long, vec_id long, copies long, x binary, homes binary"


def _routed(firsts: DataFrame, centres: dict[int, np.ndarray], least: float, overlap: int) -> DataFrame:
    """firsts (vec_id, copies, v) once for each shard, see MEMBER; a shard is a length and one of its centres."""
    given = firsts.sparkSession.sparkContext.broadcast(centres)  # fitted on a bounded sample

    def assign(batches):
        for batch in batches:
            for d, rows in _by_length(batch):
                x = np.asarray(rows.column("v").combine_chunks().flatten()).reshape(rows.num_rows, -1)
                centres_ = given.value.get(d)
                home = shards_of(unit(x), centres_, least, overlap) if centres_ is not None else np.zeros((len(x), 1), np.int64)
                row, slot = np.nonzero(home >= 0)
                shard = (d << 32) | home[row, slot]
                raw = [r.tobytes() for r in x.astype("<f8")]
                homes = [h.tobytes() for h in np.split(shard.astype("<i8"), np.searchsorted(row, np.arange(1, len(x))))]
                columns = [pa.array(shard, pa.int64()), rows.column("vec_id").combine_chunks().take(pa.array(row)), rows.column("copies").combine_chunks().take(pa.array(row))]
                columns += [pa.array([raw[i] for i in row], pa.binary()), pa.array([homes[i] for i in row], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "vec_id", "copies", "x", "homes"])

    return firsts.mapInArrow(lean(assign), MEMBER)


def _by_length(batch: pa.RecordBatch):
    t = pa.Table.from_batches([batch])
    size = np.array([len(v) for v in batch.column("v").to_pylist()], np.int64) if batch.num_rows else np.zeros(0, np.int64)
    for d in np.unique(size).tolist():
        yield d, t.filter(pa.array(size == d))


def _found(scratch: Scratch, member: DataFrame, least: float, block: int) -> DataFrame:
    """(vec_id, links, a, b): summed links of vectors, and edges of what they are joined to."""
    counts = member.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
    counts = counts.select("shard", F.ceil(F.col("rows") / block).cast("long").alias("blocks"))  # one row a centre
    placed = scratch.write(member.join(F.broadcast(counts), "shard").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("blocks"))), "placed")

    def build(t: pa.Table) -> pa.Table:
        ids = t["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        graph = build_graph(unit(_matrix(t["x"])[order]).astype(np.float32))
        return pa.table({"vec_id": pa.array(ids), "near": pa.array([ids[g].astype("<i8").tobytes() for g in graph], pa.binary())})

    lists = placed.select("shard", "block", "vec_id", "x").groupBy("shard", "block").applyInArrow(build, "vec_id long, near binary")
    united = scratch.write(lists.groupBy("vec_id").agg(F.collect_list("near").alias("near")), "united")  # a list a shard that holds the vector

    # Queries of block i meet block j's graph for i <= j.
    index = placed.join(united, "vec_id").select("shard", "block", "blocks", "vec_id", "copies", "x", "homes", "near")
    as_index = index.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("block"))).alias("i"), F.col("block").alias("j"), F.lit(True).alias("is_index"), "vec_id", "copies", "x", "homes", "near")
    as_query = index.where("block < blocks - 1").select("shard", F.col("block").alias("i"), F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("j"), F.lit(False).alias("is_index"), "vec_id", "copies", "x", "homes", F.lit(None).cast("array<binary>").alias("near"))

    def search(t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        shard = int(t["shard"][0].as_py())
        mask = t["is_index"].to_numpy()
        ids, copies, x, homes = t["vec_id"].to_numpy(), t["copies"].to_numpy(), unit(_matrix(t["x"])), _homes(t["homes"])
        single = x.astype(np.float32)
        node_ids = ids[mask]
        graph = []
        for lists_ in t["near"].filter(pa.array(mask)).to_pylist():
            want = np.unique(np.frombuffer(b"".join(lists_), "<i8"))
            at = np.minimum(np.searchsorted(node_ids, want), len(node_ids) - 1)
            graph.append(at[node_ids[at] == want])
        here = np.flatnonzero(mask)
        same = mask.all()
        asked = here if same else np.flatnonzero(~mask)
        hit = audited_search(single[here], _padded(graph), single[asked], least - SLACK, np.arange(len(here)) if same else None, ids[asked])
        if same:  # both ways may have been found, or one
            hit |= hit.T.copy()
            hit = np.triu(hit, 1)
        links, labels = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for s in range(0, len(asked), 64):  # pairs of 64 queries at a time
            qa, kb = np.nonzero(hit[s : s + 64])
            for e in range(0, len(qa), 200_000):
                a, b = asked[s + qa[e : e + 200_000]], here[kb[e : e + 200_000]]
                # The first shard that holds both counts the pair.
                good = (np.einsum("ij,ij->i", x[a], x[b]) >= least) & (first_common(homes[a], homes[b]) == shard)
                a, b = a[good], b[good]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                labels = joined_labels(labels, a, b)
        with_links, low = np.flatnonzero(links), np.flatnonzero(labels != np.arange(len(ids)))
        k, m = len(with_links), len(low)
        return pa.table(
            {
                "vec_id": pa.concat_arrays([pa.array(ids[with_links], pa.int64()), pa.nulls(m, pa.int64())]),
                "links": pa.concat_arrays([pa.array(links[with_links], pa.int64()), pa.nulls(m, pa.int64())]),
                "a": pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(ids[labels[low]], pa.int64())]),
                "b": pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(ids[low], pa.int64())]),
            }
        )

    found = as_index.union(as_query).groupBy("shard", "i", "j").applyInArrow(search, "vec_id long, links long, a long, b long")
    found = scratch.write(found, "found")
    scratch.drop("placed", "united")
    return found


def audit(firsts: DataFrame, found: DataFrame, least: float, queries: int) -> float | None:
    """Recall of at most ``queries`` vectors, those of smallest hash of ids divisible by 50, against all vectors.

    It is the lesser of two: the mean over queries, in which a vector of one
    link counts as much as one of a million, and the share of all links. None
    where no query has a link.
    """
    spark = firsts.sparkSession
    few = firsts.where("vec_id % 50 = 0").orderBy(F.xxhash64("vec_id"), "vec_id").limit(queries).select("vec_id", "v").toArrow()
    asked = {d: (rows["vec_id"].to_numpy(), unit(np.array(rows["v"].to_pylist()))) for b in few.to_batches() for d, rows in _by_length(b)}
    given = spark.sparkContext.broadcast(asked)

    def count(batches):
        for batch in batches:
            for d, rows in _by_length(batch):
                if d in given.value:
                    ids, q = given.value[d]
                    x = unit(np.asarray(rows.column("v").combine_chunks().flatten()).reshape(rows.num_rows, -1))
                    near = (q @ x.T >= least) & (ids[:, None] != rows.column("vec_id").to_numpy())
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array((near * rows.column("copies").to_numpy()).sum(1))], names=["vec_id", "links"])

    there = firsts.mapInArrow(lean(count), "vec_id long, links long").groupBy("vec_id").agg(F.sum("links").alias("there"))
    got = found.where("vec_id is not null").groupBy("vec_id").agg(F.sum("links").alias("links"))
    rows = there.where("there > 0").join(got, "vec_id", "left").select(F.coalesce("links", F.lit(0)), "there").collect()  # one a query
    if not rows:
        return None
    return min(sum(got / links for got, links in rows) / len(rows), sum(r[0] for r in rows) / sum(r[1] for r in rows))


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    *,
    least: float = 0.95,
    block: int = 4096,
    overlap: int = 3,
    sample: int = 20_000,
    sample_bytes: int = 64_000_000,
    audit_queries: int = 500,
    scratch: Scratch | None = None,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall) of each row.

    Vectors that are null, empty, zero, or that hold null or non-finite
    components link with nothing; those of unlike lengths don't link. Rows of
    one id are vectors of their own, and so are rows without one, which stand
    after all others; of a component one row is kept. Other columns are
    ignored. Centres are fitted, for each length of more than ``block``
    vectors, on at most ``sample`` of them and ``sample_bytes``, those of
    smallest hash; all vectors are indexed and all are queries. recall: of the
    audit of at most audit_queries queries, by query and by link; null where
    they have no links.
    """
    spark: SparkSession = vectors.sparkSession
    scratch = scratch or Scratch(spark, "embedding-dedup")
    v = F.col("v")
    all_, names = own_rows(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")), scratch, "vec_id")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))
    sized = all_.select("vec_id", F.when(fine, v).alias("v"), F.when(fine, F.xxhash64("v")).alias("k1"), F.when(fine, F.xxhash64(F.reverse("v"), F.lit(1))).alias("k2"))
    sized = scratch.write(sized, "keys")
    keys = sized.where("v is not null")
    classes = scratch.write(keys.groupBy("k1", "k2").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies")), "classes")
    firsts = scratch.write(keys.join(classes.select(F.col("first").alias("vec_id"), "copies"), "vec_id").select("vec_id", "copies", "v"), "firsts")
    lengths = {r[0]: r[1] for r in firsts.groupBy(F.size("v")).count().where(F.col("count") > block).collect()}  # as many rows as lengths
    samples = {}
    for d in lengths:
        most = max(1, min(sample, sample_bytes // (8 * d)))
        rows = firsts.where(F.size("v") == d).orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("v").toArrow()["v"].combine_chunks()
        samples[d] = unit(np.asarray(rows.flatten()).reshape(-1, d))
    while True:
        centres = {d: choose_centres(x, lengths[d], block, max(1, min(-(-2 * lengths[d] // block), len(x) // 8)), least, overlap) for d, x in samples.items()}
        member = scratch.write(_routed(firsts, centres, least, overlap), "member")
        found = _found(scratch, member, least, block)
        scratch.drop("member")
        recall = audit(firsts, found, least, audit_queries)
        if recall is None or recall >= TARGET_RECALL or overlap >= max([0, *map(len, centres.values())]):
            break
        overlap *= 2
    links = found.where("vec_id is not null").groupBy(F.col("vec_id").alias("first")).agg(F.sum("links").alias("links"))
    joined = components(scratch, found.where("a is not null").select("a", "b")).select(F.col("node").alias("first"), "component")
    by_class = classes.join(links, "first", "left").join(joined, "first", "left")
    by_class = scratch.write(by_class.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "first").alias("component_id")), "by-class")
    scratch.drop("found", "firsts", "classes")
    rows = sized.select("vec_id", "k1", "k2").join(by_class, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    recall = F.lit(recall).cast("double").alias("recall")
    out = rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"), recall)
    return given_ids(out, names, "vec_id", "component_id")


def op2_embedding_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))
