"""Hierarchical multi-length packing.

Documents are routed by length to context tiers (powers of two up to the
window); a document longer than the window gives full windows, and its rest is
routed. Each tier, the longest first, is packed into sequences of its own size:
a sequence begins with the tier's longest document that waits, its gap takes
whole documents of the shorter tiers, longest first, and what no whole one
fills takes the beginning of the shortest that waits; that one's rest goes to
the tier of its length. So every sequence is full and nothing is padded; what is
left of a task's last, unfilled sequence becomes lower powers of two. Sequences
are then dealt, tier by tier, to step groups of about equal tokens, each group
with its share of every tier.

Each task packs the documents of its own input partition and holds one buffer
of tokens at a time, so nothing is shuffled and a hot source or a very long
document is no task's burden beyond its own size; sequence ids hold the
partition in their upper bits. Partitions are file splits, so a retried task
packs the same rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from heapq import heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import lean, table, vocabulary_path

PIECE = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, sequence_tokens long, tier long, step_group long"
)
PIECE_TYPES = [pa.int64()] * 10


Piece = tuple[int, int, int]  # item, start, length


def pack_lengths(lengths: list[int], window: int, tiers: tuple[int, ...]) -> list[tuple[int, list[Piece]]]:
    """(tier, pieces) of sequences that hold every token of the items once.

    All sequences but a few are as long as their tier; those few, of tier 0,
    are lower powers of two. Items stay whole as far as a gap allows.
    """
    out: list[tuple[int, list[Piece]]] = []
    waiting: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}  # (length, item, start), shortest first
    for item, n in enumerate(lengths):
        out += [(window, [(item, start, window)]) for start in range(0, n - window + 1, window)]
        if n % window:
            rest = n % window
            waiting[next(t for t in tiers if rest <= t)].append((rest, item, n - rest))
    for line in waiting.values():
        line.sort()
    for k in range(len(tiers) - 1, -1, -1):
        own, shorter = waiting[tiers[k]], [waiting[t] for t in tiers[k::-1]]  # its own tier fills it too, where that fits
        while own:
            n, item, start = own.pop()
            sequence, room = [(item, start, n)], tiers[k] - n
            while room:
                line = next((x for x in shorter if x and x[0][0] <= room), None)
                if line is not None:  # the longest that fits
                    n, item, start = line.pop(bisect_right(line, (room, len(lengths), 0)) - 1)
                    sequence.append((item, start, n))
                    room -= n
                    continue
                line = next((x for x in reversed(shorter) if x), None)
                if line is None:
                    break
                n, item, start = line.pop(0)
                sequence.append((item, start, room))
                insort(waiting[next(t for t in tiers if n - room <= t)], (n - room, item, start + room))
                room = 0
            if room:
                out += [(0, s) for s in _powers(sequence, tiers[k] - room)]
            else:
                out.append((tiers[k], sequence))
    return out


def deal(used: list[int], step_tokens: int) -> list[int]:
    """Step group of each sequence, by the tokens it holds: as few groups as can be, each of at most step_tokens.

    The longest are dealt first, each to the group with the fewest tokens; as
    lengths are powers of two, groups differ by less than one sequence and each
    gets its share of every length.
    """
    groups = [(0, g) for g in range(-(-sum(used) // step_tokens))]
    out = [0] * len(used)
    for s in sorted(range(len(used)), key=lambda s: -used[s]):
        tokens, g = groups[0]
        out[s] = g
        heapreplace(groups, (tokens + used[s], g))
    return out


def _powers(pieces: list[tuple[int, int, int]], n: int) -> list[list[tuple[int, int, int]]]:
    """The pieces, cut into sequences of the powers of two that n is the sum of."""
    out, pieces = [], pieces[::-1]
    for bit in range(n.bit_length() - 1, -1, -1):
        room = n & (1 << bit)
        sequence = []
        while room:
            item, start, length = pieces.pop()
            take = min(room, length)
            sequence.append((item, start, take))
            room -= take
            if take < length:
                pieces.append((item, start + take, length - take))
        if sequence:
            out.append(sequence)
    return out


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    window: int = 2048,
    tiers: tuple[int, ...] = (256, 512, 1024, 2048),
    end_id: int = 1,
    buffer_tokens: int = 1_000_000,
    step_tokens: int = 65_536,
    vocabulary: str | None = None,
) -> DataFrame:
    """One row per piece of a document, see PIECE.

    Null and empty texts are the end id alone. Each id of a document lies in
    one piece; repeated rows are packed each. window and tiers: powers of two.
    buffer_tokens: a task packs whenever it holds that many (memory bound, not
    a limit of the input); only the last, unfilled window of a task is carried.
    step_group: groups of a task's buffer of at most step_tokens tokens (a
    multiple of the window), equal to within one sequence. Ids are only handed
    on: rows of one id and rows without one are packed each.
    """

    def run(batches):
        path = vocabulary or vocabulary_path()
        part = TaskContext.get().partitionId()
        next_id, next_group = part << 36, part << 36
        held: list[tuple[int, np.ndarray, int, int]] = []  # doc_id, ids, start of the ids in the document, tokens of the document

        def flush(last: bool):
            nonlocal held, next_id, next_group
            sequences = pack_lengths([len(x[1]) for x in held], window, tiers)
            keep: list[Piece] = []
            if not last:  # what fills no sequence goes on to the next buffer
                keep = [p for tier, s in sequences if not tier for p in s]
                sequences = [x for x in sequences if x[0]]
            used = [sum(p[2] for p in s) for _, s in sequences]
            columns = [[] for _ in PIECE_TYPES]
            for (tier, pieces), size, group in zip(sequences, used, deal(used, step_tokens), strict=True):
                offset = 0
                for item, start, n in pieces:
                    doc, ids, base, total = held[item]
                    crc = zlib.crc32(ids[start : start + n].astype("<u4").tobytes())
                    row = (doc, base + start, n, crc, total, next_id, offset, size, tier or size, next_group + group)
                    for c, x in zip(columns, row, strict=True):
                        c.append(x)
                    offset += n
                next_id += 1
            next_group += -(-sum(used) // step_tokens)
            held = [(held[i][0], held[i][1][s : s + n], held[i][2] + s, held[i][3]) for i, s, n in sorted(keep)]
            names = [f.split()[0] for f in PIECE.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PIECE_TYPES, strict=True)], names=names)

        waiting = 0
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for first, some in bpe.chunks(texts):
                ids, n = bpe.encode(some, path, "merge")
                stop = np.cumsum(n)
                for k, (s, e) in enumerate(zip((stop - n).tolist(), stop.tolist(), strict=True)):
                    own = np.append(ids[s:e], ids.dtype.type(end_id))
                    held.append((doc_ids[first + k], own, 0, len(own)))
                    waiting += len(own)
                if waiting >= buffer_tokens:
                    yield flush(False)
                    waiting = sum(len(x[1]) for x in held)
        yield flush(True)

    one = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return one.mapInArrow(lean(run), PIECE)


def op5_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
