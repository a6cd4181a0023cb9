"""Delivery in order: rows of a key come out by their numbers, one after the other.

A key's state is the number that is due and the rows that wait for it. A row
that is due goes out at once, with those behind it that wait; a row ahead waits
on disk, in a block of neighbouring numbers: a micro-batch reads and writes each
block that it touches once, whatever rows come. If what is missing hasn't come ``patience`` after the first row that
waits for it, an event-time timer gives it up and goes on with the smallest
number that waits. What comes after its turn is told as late and not delivered.

Keys are independent: a slow one holds back itself alone. How much is taken in
at once is the source's ``maxFilesPerTrigger``: the next files are read when a
micro-batch is delivered.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .keyed import state_session

MILLIS = "__millis"
BLOCK = 256  # numbers whose waiting rows are one entry of the state
DELIVERED, AFTER_GAP, LATE, REPEATED = "delivered", "after_gap", "late", "repeated"


class Waiting:
    """A key's rows that wait, {seq: (arrived, values)} a block; earliest: when the first row of each block came."""

    def __init__(self, blocks, earliest: dict[int, int]):
        self.blocks, self.earliest, self.read, self.changed = blocks, earliest, {}, set()

    def _block(self, number: int) -> dict[int, tuple]:
        if number not in self.read:
            self.read[number] = pickle.loads(self.blocks.getValue((number,))[0]) if number in self.earliest else {}
        return self.read[number]

    def __contains__(self, seq: int) -> bool:
        return seq // BLOCK in self.earliest and seq in self._block(seq // BLOCK)

    def put(self, seq: int, arrived: int, values: list) -> None:
        number = seq // BLOCK
        self._block(number)[seq] = (arrived, values)
        self.earliest[number] = min(arrived, self.earliest.get(number, arrived))
        self.changed.add(number)

    def take(self, seq: int) -> list:
        number = seq // BLOCK
        block = self._block(number)
        _, values = block.pop(seq)
        self.changed.add(number)
        if not block:
            del self.earliest[number]
        return values

    def first(self) -> int:
        return min(self._block(min(self.earliest)))

    def oldest(self) -> int | None:
        """When the first of all came."""
        for number in self.changed & self.earliest.keys():
            self.earliest[number] = min(arrived for arrived, _ in self.read[number].values())
        return min(self.earliest.values(), default=None)

    def write(self, known: set[int]) -> None:
        """Writes the blocks that have changed; known: those that the state had."""
        for number in self.changed:
            if self.read[number]:
                self.blocks.updateValue((number,), (pickle.dumps(self.read[number]),))
            elif number in known:
                self.blocks.removeKey((number,))


class InOrder(StatefulProcessor):
    """rows (key columns, seq, at, payload) to rows with ``status`` and ``place``, a running number of the key's delivered rows."""

    def __init__(self, by: list[str], seq: str, payload: list[str], first: int):
        self.by, self.seq, self.payload, self.first = by, seq, payload, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.row = handle, Row(*self.by, self.seq, *self.payload, "status", "place")
        self.turn = handle.getValueState("turn", "due long, place long, timer long, earliest binary")
        self.blocks = handle.getMapState("blocks", "number long", "rows binary")

    def _state(self) -> tuple[list, Waiting, set[int]]:
        """(due, place, timer), what waits, and the blocks that it is in."""
        *state, earliest = self.turn.get() or (self.first, 0, None, None)
        earliest = pickle.loads(earliest) if earliest else {}
        return state, Waiting(self.blocks, earliest), set(earliest)

    def _out(self, key, seq: int, values, status: str, state: list) -> Row:
        place = None
        if status in (DELIVERED, AFTER_GAP):
            state[1] += 1
            place = state[1]
        return self.row(*key, seq, *values, status, place)

    def _run(self, key, state: list, waiting: Waiting) -> Iterator[Row]:
        """The rows that wait and are due."""
        while state[0] in waiting:
            yield self._out(key, state[0], waiting.take(state[0]), DELIVERED, state)
            state[0] += 1

    def _keep(self, state: list, waiting: Waiting, known: set[int]) -> None:
        """Writes the state, with a timer for the gap in front of what waits, or none."""
        wanted = waiting.oldest()
        if wanted != state[2]:
            if state[2] is not None:
                self.handle.deleteTimer(state[2])
            if wanted is not None:
                self.handle.registerTimer(wanted)
        state[2] = wanted
        waiting.write(known)
        self.turn.update((*state, pickle.dumps(waiting.earliest) if waiting.earliest else None))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        numbered = sorted((r for r in rows if r[self.seq] is not None), key=lambda r: (r[self.seq], r[MILLIS]))
        if not numbered:
            return
        state, waiting, known = self._state()
        for row in numbered:
            seq, values = row[self.seq], [row[c] for c in self.payload]
            if seq < state[0]:
                yield self._out(key, seq, values, LATE, state)
            elif seq == state[0]:
                yield self._out(key, seq, values, DELIVERED, state)
                state[0] += 1
                yield from self._run(key, state, waiting)
            elif seq in waiting:
                yield self._out(key, seq, values, REPEATED, state)
            else:
                waiting.put(seq, row[MILLIS], values)
        self._keep(state, waiting, known)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        (state, waiting, known), now = self._state(), timerValues.getCurrentWatermarkInMs()
        state[2] = None  # this one is spent
        while (oldest := waiting.oldest()) is not None and oldest <= now:
            state[0] = waiting.first()
            yield self._out(key, state[0], waiting.take(state[0]), AFTER_GAP, state)
            state[0] += 1
            yield from self._run(key, state, waiting)
        self._keep(state, waiting, known)

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, by: list[str], seq: str, at: str, patience: int = 60, first: int = 1) -> DataFrame:
    """The stream's rows in order of ``seq`` within each key, with ``status`` and ``place``.

    at: when a row came, the event time of the timers. The watermark stays
    ``patience`` seconds behind the last row that came, and a gap is given up
    when it passes the first row that waits behind it. first: the number of a key's first row. Rows without a
    key or a time are left out; those without a number only move the clock.
    """
    payload = [c for c in stream.columns if c not in (*by, seq, at)]
    kind = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    whole = stream.where(" and ".join(f"`{c}` is not null" for c in (*by, at))).withColumns({seq: F.col(seq).cast("long"), at: F.col(at).cast("timestamp")})
    timed = whole.withWatermark(at, f"{patience} seconds").withColumn(MILLIS, F.unix_millis(at))
    out = ", ".join([*(f"`{c}` {kind[c]}" for c in by), f"`{seq}` long", *(f"`{c}` {kind[c]}" for c in payload), "status string, place long"])
    processor = InOrder(by, seq, payload, first)
    return timed.groupBy(*by).transformWithState(processor, out, "Append", "EventTime")


def start(spark: SparkSession, source: str, schema: str, path: str, checkpoint: str, by: list[str], seq: str, at: str, *, patience: int = 60, first: int = 1, most_files: int = 1, partitions: int | None = None) -> StreamingQuery:
    """Delivers a folder of files as a stream, ``most_files`` at a time, into the table under path."""
    stream = state_session(spark, partitions).readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(source)
    writer = in_order(stream, by, seq, at, patience, first).writeStream.format("parquet").outputMode("append")
    return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
