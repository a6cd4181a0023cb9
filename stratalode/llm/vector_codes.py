"""Vector codes: integer parts of vectors, each told by the number of its nearest codebook entry.

Vectors become integers and are cut into equal parts. At each part position
equal parts are one distinct row with a weight, so that a part that many
vectors share is assigned once a round. Weighted Lloyd rounds run over the
distinct rows: a task assigns its rows to the codebook's entries and sums them,
so a round moves one row for each entry and task. Codes and errors are then
joined back to the vectors by part.

A batch's equal parts are one row that lists their vectors, both when weights
are counted and when codes come back: a part of any number of vectors is some
rows a batch in each shuffle. The codebooks, ``entries`` rows for each part
position and part length, are all that the driver holds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, few, lean, table

PARTS = 4
MOST = 1 << 26  # integers are held to this on either side of 0, so that squared distances are exact
RECORD = "pos int, part binary, members array<long>, vec_ids array<long>, labels array<string>"
Codebooks = dict[int, np.ndarray]  # components of a part -> integers by part position, entry, component


def integers(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int, parts: int) -> DataFrame:
    """(vec_id, label, ints) of the rows whose vector is of finite numbers; ints padded with zeros to a multiple of ``parts``."""
    given = F.col(vector_col).cast("array<double>")
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), given.alias("v"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kept = rows.where(F.col("v").isNotNull() & ~F.coalesce(F.exists("v", odd), F.lit(False)))
    whole = F.transform("v", lambda x: F.least(F.greatest(F.floor(F.least(F.greatest(x * scale, F.lit(-float(MOST))), F.lit(float(MOST)))), F.lit(-MOST)), F.lit(MOST)).cast("int"))
    pad = F.array_repeat(F.lit(0), F.pmod(-F.size("v"), F.lit(parts)))
    return kept.select("vec_id", "label", F.concat(whole, pad).alias("ints"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), width) if width else np.zeros((len(column), 0), "<i4")


def _listed(groups: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """values as lists, by the group (0 to n - 1) of each."""
    order = np.argsort(groups, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(groups, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values.take(pa.array(order)))


def _records(parts: int):
    """Distinct parts of each batch by position, with the vectors that have them; ids and labels go with the first position."""

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            lists = batch.column(2)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                flat = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
                ints = flat.astype("<i4").reshape(len(rows), size)
                members = pa.array(number + np.arange(len(rows), dtype=np.int64))
                number += len(rows)
                ids, labels = (batch.column(c).take(pa.array(rows)) for c in (0, 1))
                width = size // parts
                for pos in range(parts):
                    own = np.ascontiguousarray(ints[:, pos * width : (pos + 1) * width])
                    said = own.view(np.dtype((np.void, 4 * width))).reshape(-1) if width else np.zeros(len(own), "V1")
                    distinct, group = np.unique(said, return_inverse=True)
                    n = len(distinct)
                    part = pa.array([x.tobytes() if width else b"" for x in distinct], pa.binary())
                    with_rows = [_listed(group, n, x) if not pos else pa.nulls(n, pa.list_(x.type)) for x in (ids, labels)]
                    columns = [pa.array(np.full(n, pos, np.int32)), part, _listed(group, n, members), *with_rows]
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in RECORD.split(", ")])

    return run


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row of integers: the nearest entry, the first of those as near. Exact."""
    most = max([int(np.abs(a).max()) for a in (x, entries) if a.size] or [0])
    small = 4 * most * most * max(1, x.shape[1]) < 1 << 53  # products and sums are whole in doubles
    x, entries = (a.astype(np.float64 if small else np.int64) for a in (x, entries))
    codes, errors = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for at in range(0, len(x), 4096):
        some = x[at : at + 4096]
        far = (some * some).sum(1)[:, None] - 2 * (some @ entries.T) + (entries * entries).sum(1)[None, :]
        best = far.argmin(1)
        codes[at : at + 4096], errors[at : at + 4096] = best, far[np.arange(len(some)), best]
    return codes, errors


def _by_shape(batches):
    """(position, components, rows of the batch, their parts as integers)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        pos, part = batch.column(0).to_numpy(), batch.column(1)
        width = np.array([len(b) for b in part.to_pylist()]) // 4
        for p, w in sorted(set(zip(pos.tolist(), width.tolist(), strict=True))):
            rows = np.flatnonzero((pos == p) & (width == w))
            taken = batch.take(pa.array(rows))
            yield p, w, taken, _matrix(taken.column(1), w)


def first_codebooks(ints: DataFrame, entries: int, parts: int) -> Codebooks:
    """The parts of the ``entries`` vectors of smallest ids, for each length of vectors."""
    order = Window.partitionBy(F.size("ints")).orderBy(F.col("vec_id").asc_nulls_last(), "ints")
    first = ints.select("ints", F.row_number().over(order).alias("k")).where(F.col("k") <= entries)
    lengths: dict[int, list] = {}
    for r in first.collect():  # ``entries`` rows a length
        lengths.setdefault(len(r.ints), []).append((r.k, r.ints))
    return {n // parts: np.array([x for _, x in sorted(rows)], np.int64).reshape(len(rows), parts, n // parts).transpose(1, 0, 2) for n, rows in lengths.items()}


def lloyd_round(distinct: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks once each entry is the floored mean of the weighted parts that are nearest to it; an entry without parts stays."""
    held = distinct.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        sums: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for p, w, batch, x in _by_shape(batches):
            book = held.value[w][p]
            codes, _ = nearest(x, book)
            weight = batch.column(2).to_numpy()
            count, total = sums.setdefault((p, w), (np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64)))
            np.add.at(count, codes, weight)
            np.add.at(total, codes, x.astype(np.int64) * weight[:, None])
        for (p, w), (count, total) in sums.items():
            met = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(met), v, np.int32)) for v in (p, w)] + [pa.array(met.astype(np.int32)), pa.array(count[met]), pa.array(total[met].tolist(), pa.list_(pa.int64()))], names=["pos", "width", "entry", "n", "sums"])

    told = distinct.mapInArrow(lean(run, 10_000), "pos int, width int, entry int, n long, sums array<long>")
    each = told.select("pos", "width", "entry", "n", F.posexplode_outer("sums").alias("k", "s"))
    each = each.groupBy("pos", "width", "entry", "k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    new = {w: book.copy() for w, book in books.items()}
    for r in each.collect():  # a row for each component of an entry
        if r.k is not None:
            new[r.width][r.pos, r.entry, r.k] = int(r.s) // r.n
    held.unpersist()
    return new


def codebook_digest(book: np.ndarray) -> str:
    """SHA-256 of the entries' decimal components by part, entry and component."""
    return hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, entries: int = 256, rounds: int = 4, scale: int = 1024, parts: int = PARTS, scratch: Scratch | None = None
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each kept vector.

    Vectors that are null or hold null or non-finite components are dropped.
    Vectors of each length have codebooks of their own; a length that is no
    multiple of ``parts`` is filled with zeros; an empty vector has the code
    of zeros and no error. Integers are held to 2**26 on either side. Rows of
    one id are vectors each, and so are rows without one, which come last where
    ids are ordered; of vectors of one id the smaller is first. Labels are
    compared as text, null ones with each other. Other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "vector-codes")
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    ints = integers(vectors, id_col, vector_col, label_col, scale, parts)
    books = first_codebooks(ints, entries, parts)
    records = scratch.write(ints.mapInArrow(lean(_records(parts), 10_000), RECORD), "records")
    weighted = records.groupBy("pos", "part").agg(F.sum(F.size("members").cast("long")).alias("weight"))
    distinct = scratch.write(weighted.select("pos", "part", "weight"), "distinct")
    for _ in range(rounds):
        books = lloyd_round(distinct, books)
    held = spark.sparkContext.broadcast({w: (book, codebook_digest(book)) for w, book in books.items()})

    def assign(batches):
        for p, w, batch, x in _by_shape(batches):
            codes, errors = nearest(x, held.value[w][0][p])
            sha = pa.array([held.value[w][1]]).take(pa.array(np.zeros(len(codes), np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes.astype(np.int32)), pa.array(errors), sha], names=["pos", "part", "entry", "error", "sha"])

    codes = distinct.mapInArrow(lean(assign, 10_000), "pos int, part binary, entry int, error long, sha string")
    back = records.join(codes, ["pos", "part"])
    of_row = F.arrays_zip("members", F.coalesce("vec_ids", F.array_repeat(F.lit(None).cast("long"), F.size("members"))).alias("id"), F.coalesce("labels", F.array_repeat(F.lit(None).cast("string"), F.size("members"))).alias("label"))
    each = back.select("pos", "entry", "error", "sha", F.inline(of_row).alias("member", "id", "label"))
    hexes = [F.lpad(F.lower(F.hex(F.max(F.when(F.col("pos") == p, F.col("entry"))))), 2, "0") for p in range(parts)]
    rows = each.groupBy("member").agg(F.max("id").alias("vec_id"), F.max("label").alias("label"), F.concat(*hexes).alias("code"), F.sum("error").alias("error"), F.max("sha").alias("codebooks_sha256"))
    rows = scratch.write(rows, "rows")
    sums = few(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    return rows.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op11_vector_codes(spark, sf_dir):
    return vector_codes(table(spark, sf_dir, "embeddings"))
