"""Tables that several writers change: commits that take place whole or not at all.

A table is cut into slices by a hash of its key; each slice is a folder that is
never changed. A commit rewrites the slices that its rows fall in and writes one
log entry, which lists the folder of every slice. Entries are numbered, and a
number is taken by whoever creates its file first. A writer that finds its
number taken looks at what the others' commits touched: if that is other slices,
it takes the next number; if not, it starts anew from their rows, so that no
change is lost. Readers see the slices of one entry.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

SLICE = "__slice"
Merge = Callable[[DataFrame, DataFrame], DataFrame]


class Conflict(Exception):
    """Another writer has changed the same slices."""


@dataclass
class Attempt:
    """Slices written on top of a version, not yet committed: slice -> folder, None if it is empty."""

    base: int
    slices: dict[int, str | None]


class Committed:
    """A table under a folder, with its log; by: the columns that place a row in a slice."""

    def __init__(self, spark: SparkSession, path: str, schema: str, by: list[str], slices: int = 64):
        self.spark, self.path, self.schema, self.by, self.n = spark, path, schema, by, slices

    def version(self) -> int:
        """The number of the last commit, 0 before the first."""
        return max((int(n.removesuffix(".json")) for n in store.names(self.spark, f"{self.path}/log") if n.endswith(".json")), default=0)

    def _entry(self, number: int) -> dict:
        if not number:
            return {"touched": [], "slices": {}}
        return json.loads(store.read_text(self.spark, f"{self.path}/log/{number:012}.json"))

    def _folders(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows as a version left them, the last one if none is named."""
        return self._folders(sorted(self._entry(self.version() if version is None else version)["slices"].values()))

    def prepare(self, new: DataFrame, merge: Merge, version: int | None = None) -> Attempt:
        """Writes what a commit of new rows leaves in their slices; merge: (the slices' rows, new rows) to their rows."""
        base = self.version() if version is None else version
        place = F.pmod(F.xxhash64(*self.by), F.lit(self.n)).cast("int")
        touched = sorted(r[0] for r in new.select(place.alias(SLICE)).distinct().collect())  # at most as many as there are slices
        before = self._entry(base)["slices"]
        old = self._folders([before[str(k)] for k in touched if str(k) in before])
        folder = f"rows/{uuid.uuid4().hex}"
        merge(old, new.select(*old.columns)).withColumn(SLICE, place).write.partitionBy(SLICE).parquet(f"{self.path}/{folder}")
        made = set(store.numbers(self.spark, f"{self.path}/{folder}", f"{SLICE}="))
        if not made <= set(touched):
            raise ValueError("merged rows must keep the keys of those that they come from")
        return Attempt(base, {k: f"{folder}/{SLICE}={k}" if k in made else None for k in touched})

    def commit(self, attempt: Attempt) -> int:
        """The version that the attempt becomes; Conflict if its slices were changed meanwhile."""
        at, others = attempt.base, self._entry(attempt.base)["slices"]
        while True:
            while (last := self.version()) > at:
                at += 1
                entry = self._entry(at)
                if set(entry["touched"]) & set(attempt.slices):
                    raise Conflict(f"version {at} changed the same slices as a commit on top of {attempt.base}")
                others = entry["slices"]
            slices = {k: f for k, f in others.items() if int(k) not in attempt.slices} | {str(k): f for k, f in attempt.slices.items() if f}
            entry = json.dumps({"touched": sorted(attempt.slices), "slices": slices}, sort_keys=True)
            if store.create_text(self.spark, f"{self.path}/log/{last + 1:012}.json", entry):
                return last + 1

    def write(self, new: DataFrame, merge: Merge, tries: int = 10) -> int:
        """Commits new rows, from the start again where others were first."""
        for _ in range(tries):
            try:
                return self.commit(self.prepare(new, merge))
            except Conflict:
                continue
        raise Conflict(f"no commit in {tries} tries")

    def upsert(self, new: DataFrame, keys: list[str]) -> int:
        """Commits new rows in place of those of the same keys."""
        return self.write(new, lambda old, rows: store.upsert(old, rows, keys))

    def forget(self, keep: int = 10) -> None:
        """Removes the rows that only entries before the last ``keep`` name, and those entries."""
        last = self.version()
        kept = range(max(1, last - keep + 1), last + 1)
        live = {f for n in kept for f in self._entry(n)["slices"].values()}
        old = [int(n.removesuffix(".json")) for n in store.names(self.spark, f"{self.path}/log") if n.endswith(".json") and int(n.removesuffix(".json")) < kept.start]
        gone = {f for n in old for f in self._entry(n)["slices"].values()} - live
        store.remove(self.spark, *[f"{self.path}/{f}" for f in sorted(gone)], *[f"{self.path}/log/{n:012}.json" for n in old])
