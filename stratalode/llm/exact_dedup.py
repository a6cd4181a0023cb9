"""Exact dedup through an extendible-hash index on shared files.

A task compares the texts of its own rows first: equal ones, without ASCII
blanks, become one record that counts them and lists their ids. The index is
over the records. Its directory maps a hash's leading bits to a bucket; a
bucket that holds more records than its capacity is split in two by the next
bit, and the directory doubles when that bucket was as deep as the directory.
Owner tasks each take a range of buckets, i.e. of hashes. A record whose hash no
other has is settled there; of those that share one the texts are fetched and
compared in the same owner task, byte by byte, with the heads of the hash's
chain: equal ones join an entry, another text gets an entry of its own. The
entries are files in the shared folder, and say for each record which row
stays and how large the group is. Records then hand that to their rows.

So a group of any size is some records a task, its ids never meet in one place,
and only texts of records that share a hash move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, given_ids, lean, own_rows, table

_BLANKS = b" \t\n\x0b\x0c\r"
BROADCAST_IDS = 500_000
RECORD = "record long, h long, sha string, size long, best_chars long, best_id long, first long, members binary"
ENTRY = "bucket long, h long, chain long, sha string, record long, keep_id long, group_size long"


def normal(text: str | None) -> bytes:
    return (text or "").encode().translate(None, _BLANKS)


def leading_bits(norm: bytes) -> int:
    """The key of a normalised text: 64 bits of its SHA-256 digest."""
    return int.from_bytes(hashlib.sha256(norm).digest()[:8], "big", signed=True)


def _records(key_of: Callable[[bytes], int], most_bytes: int):
    """One row for each text that differs from all others held; texts are held up to most_bytes, then the next records begin."""

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        chains: dict[int, list[list]] = {}
        held = 0

        def flush():
            nonlocal number
            columns = [[] for _ in range(8)]
            for h, chain in chains.items():
                for norm, ids, best in chain:
                    row = (number, h, hashlib.sha256(norm).hexdigest(), len(ids), -best[0], best[1], ids[0], np.array(ids, "<i8").tobytes())
                    for c, x in zip(columns, row, strict=True):
                        c.append(x)
                    number += 1
            chains.clear()
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in RECORD.split(", ")])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                norm, rank = normal(text), (-len(text or ""), doc)
                chain = chains.setdefault(key_of(norm), [])
                entry = next((e for e in chain if e[0] == norm), None)
                if entry is None:
                    chain.append([norm, [doc], rank])
                    held += len(norm) + 200
                    if held > most_bytes:
                        yield flush()
                        held = 0
                else:
                    entry[1].append(doc)
                    entry[2] = min(entry[2], rank)
        yield flush()

    return run


def directory(total: int, count: Callable[[list[int], int, int], dict[int, int]], capacity: int, bits: int) -> list[tuple[int, int]]:
    """Buckets (leading bits, how many) of an extendible-hash directory, in the order of the hashes.

    One bucket to begin with; those with more keys than the capacity are split
    by the next bit, again and again, as far as the hash goes.
    count(prefixes, depth, deeper): keys of the buckets ``prefixes`` of
    ``depth`` bits, by their leading ``deeper`` bits.
    """
    full, depth, done = ([0], 0, []) if total > capacity else ([], 0, [(0, 0)])
    while full:
        deeper = min(64, depth + bits)
        counts, still = count(full, depth, deeper), []
        pending = [(p, depth) for p in full]
        sums = [dict(counts)]  # by bits, from deeper upwards
        for _ in range(deeper - depth):
            up: dict[int, int] = {}
            for k, n in sums[-1].items():
                up[k >> 1] = up.get(k >> 1, 0) + n
            sums.append(up)
        while pending:
            prefix, local = pending.pop()
            if sums[deeper - local].get(prefix, 0) <= capacity:
                done.append((prefix, local))
            elif local < deeper:
                pending += [(2 * prefix, local + 1), (2 * prefix + 1, local + 1)]
            else:
                (done if local == 64 else still).append((prefix, local))
        full, depth, bits = [p for p, _ in still], deeper, 4
    return sorted(done, key=lambda b: b[0] << (64 - b[1]))


def build_directory(records: DataFrame, partitions: int, capacity: int | None) -> list[tuple[int, int]]:
    """The directory over records (h); capacity None: a quarter of a task's share, of 1000 to 500,000."""
    total = records.count()
    capacity = capacity or min(500_000, max(1000, total // (4 * partitions)))
    lead = lambda bits: F.shiftrightunsigned("h", 64 - bits) if 0 < bits else F.lit(0).cast("long")

    def count(prefixes, depth, deeper):
        rows = records.where(lead(depth).isin(prefixes)) if depth and len(prefixes) <= 1000 else records
        wanted = set(prefixes)
        found = rows.groupBy(lead(deeper).alias("lead")).count().collect()  # some rows for each bucket that splits
        return {r[0]: r[1] for r in found if r[0] >> (deeper - depth) in wanted}

    return directory(total, count, capacity, min(16, max(1, (2 * total // capacity).bit_length())))


def _settled(batches):
    """Owner task, first round: records that are alone with their hash are entries; the others stay open (keep_id null)."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    t = pa.Table.from_batches(rows).sort_by("h").combine_chunks()
    h = t["h"].to_numpy()
    alone = np.ones(len(h), bool)
    alone[1:] &= h[1:] != h[:-1]
    alone[:-1] &= h[1:] != h[:-1]
    keep = pa.array(np.where(alone, t["best_id"].to_numpy(), 0), pa.int64(), mask=~alone)
    columns = [t["bucket"], t["h"], pa.array(np.zeros(len(h), np.int64)), t["sha"], t["record"], keep, t["size"]]
    yield from pa.table(columns, names=[f.split()[0] for f in ENTRY.split(", ")]).to_batches()


def _chained(batches):
    """Owner task, second round: open records in the order of their hashes; each text is compared with its chain's heads."""
    names = [f.split()[0] for f in ENTRY.split(", ")]
    at, chain = None, []  # entries of a hash: [text, sha, (-chars, id), size, [(bucket, record)]]

    def rows():
        columns = [[] for _ in names]
        for k, (_, sha, best, size, records) in enumerate(chain):
            for bucket, record in records:
                for c, x in zip(columns, (bucket, at, k, sha, record, best[1], size), strict=True):
                    c.append(x)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "sha" else pa.int64()) for c, n in zip(columns, names, strict=True)], names=names)

    for batch in batches:
        fields = [batch.column(c).to_pylist() for c in ("bucket", "h", "sha", "record", "size", "best_chars", "best_id", "text")]
        for bucket, h, sha, record, size, chars, best_id, text in zip(*fields, strict=True):
            if h != at:
                if chain:
                    yield rows()
                at, chain = h, []
            norm, rank = normal(text), (-chars, best_id)
            entry = next((e for e in chain if e[0] == norm), None)
            if entry is None:
                chain.append([norm, sha, rank, size, [(bucket, record)]])
            else:
                entry[2], entry[3] = min(entry[2], rank), entry[3] + size
                entry[4].append((bucket, record))
    if chain:
        yield rows()


def build_index(scratch: Scratch, records: DataFrame, texts: DataFrame, capacity: int | None = None) -> DataFrame:
    """The index's files, see ENTRY: for each record its bucket, entry, the row that stays and the group's size."""
    spark = scratch.spark
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = build_directory(records, partitions, capacity)
    scratch.write(spark.createDataFrame([(k, f"{p:x}", d) for k, (p, d) in enumerate(buckets)], "bucket long, bits string, depth int"), "directory")
    begins = spark.sparkContext.broadcast(np.array([p << (64 - d) if d else 0 for p, d in buckets], np.uint64))  # 8 bytes a bucket

    def place(batches):
        for batch in batches:
            bucket = np.searchsorted(begins.value, batch.column("h").to_numpy().view(np.uint64), side="right") - 1
            yield batch.append_column("bucket", pa.array(bucket, pa.int64()))

    columns = "record long, h long, sha string, size long, best_chars long, best_id long, first long"
    placed = scratch.write(records.select(*[c.split()[0] for c in columns.split(", ")]).mapInArrow(lean(place), f"{columns}, bucket long"), "placed")
    owners = min(len(buckets), partitions)
    entries = scratch.write(placed.repartitionByRange(owners, "bucket").mapInArrow(lean(_settled), ENTRY), "entries")
    open_ = entries.where("keep_id is null").select("record")
    few = open_.limit(BROADCAST_IDS + 1).count()
    if not few:
        return entries
    open_ = placed.join(F.broadcast(open_) if few <= BROADCAST_IDS else open_, "record", "left_semi")
    of = texts.select(F.col("doc_id").alias("first"), "text")
    open_ = of.join(F.broadcast(open_) if few <= BROADCAST_IDS // 4 else open_, "first")  # a record's row is some 150 bytes
    chained = open_.repartition(owners, "bucket").sortWithinPartitions("h", "record").mapInArrow(lean(_chained), ENTRY)
    chained = scratch.write(chained, "chained")
    scratch.drop("placed")
    return entries.where("keep_id is not null").union(chained)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    bucket_capacity: int | None = None,
    key_of: Callable[[bytes], int] = leading_bits,
    held_bytes: int = 16_000_000,
    scratch: Scratch | None = None,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of each row.

    Of texts that are equal without ASCII blanks the row with the most code
    points stays, then the smallest id. Null counts as empty; empty texts and
    those of blanks only are one group. Rows of one id, and rows without one,
    are rows of their own: of each group exactly one row is kept; a null id is
    the largest. Other columns are ignored. key_of: hash of a normalised text
    (any will do: texts are compared); held_bytes: texts that a task holds.
    """
    spark: SparkSession = docs.sparkSession
    scratch = scratch or Scratch(spark, "exact-dedup")
    one, names = own_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), scratch)
    records = scratch.write(one.mapInArrow(lean(_records(key_of, held_bytes)), RECORD), "records")
    index = build_index(scratch, records, one, bucket_capacity)

    def members(batches):
        for batch in batches:
            ids = [np.frombuffer(m, "<i8") for m in batch.column("members").to_pylist()]
            row = pa.array(np.repeat(np.arange(len(ids)), [len(x) for x in ids]))
            every = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([every, *[batch.column(c).take(row) for c in ("keep_id", "group_size", "sha")]], names=["doc_id", "keep_id", "group_size", "sha"])

    told = records.select("record", "members").join(index.select("record", "keep_id", "group_size", "sha"), "record").drop("record")
    rows = told.mapInArrow(lean(members), "doc_id long, keep_id long, group_size long, sha string")
    rows = rows.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
    return given_ids(rows, names, "doc_id", "keep_id")


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))
