"""Versions: inheritance along the parent chain, tombstones, and the life of a version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalogue
from . import store

#: How far a lookup follows parents; diffs and removals follow them to the first version.
MOST_DEPTH = 50
#: A round's jumps reach this many times as far as those of the round before.
RADIX = 8


class VersionConflict(Exception):
    """The version's state doesn't allow it."""


def _jumps(edges: DataFrame) -> DataFrame:
    """(project, version, a1, ..., a8): a version's ancestors by one to eight edges (project, version, parent)."""
    rows = edges.withColumnRenamed("parent", "a1")
    for k in range(2, RADIX + 1):
        rows = rows.join(edges.select("project", F.col("version").alias(f"a{k - 1}"), F.col("parent").alias(f"a{k}")), ["project", f"a{k - 1}"], "left")
    return rows.select("project", "version", *[f"a{k}" for k in range(1, RADIX + 1)])


def chain(versions: DataFrame, most_depth: int | None = None, wanted: tuple[int, ...] | None = None) -> DataFrame:
    """(project, version, anc, depth): each version with its ancestors, itself at depth 0.

    most_depth: no further than so many parents, else to the first version.
    wanted: of these versions only. Jumps over the version edges grow eightfold
    each round, and each round's are a written table, so that a chain of n
    versions takes log8(n) rounds and one join for each, whatever its shape.
    """
    spark = versions.sparkSession
    begin = versions if wanted is None else versions.where(F.col("version").isin(*wanted))
    rows = begin.select("project", "version", F.col("version").alias("anc"), F.lit(0).alias("depth")).distinct()
    edges = versions.where("parent_version is not null").select("project", "version", F.col("parent_version").alias("parent")).distinct()
    root, step, most_steps = store.work_folder(spark, "jumps"), 1, None
    while most_depth is None or step <= most_depth:
        jumps = _jumps(edges)
        jumps.write.mode("overwrite").parquet(f"{root}/{step}")
        jumps = spark.read.schema(jumps.schema).parquet(f"{root}/{step}")
        ups = F.array(F.struct(F.lit(0).alias("far"), F.col("anc").alias("up")), *[F.struct(F.lit(k * step).alias("far"), F.col(f"a{k}").alias("up")) for k in range(1, RADIX)])
        rows = rows.join(jumps.withColumnRenamed("version", "anc"), ["project", "anc"], "left")
        rows = rows.select("project", "version", "depth", F.inline(F.filter(ups, lambda u: u["up"].isNotNull()))).select("project", "version", F.col("up").alias("anc"), (F.col("depth") + F.col("far")).alias("depth"))
        if most_depth is not None:
            rows = rows.where(F.col("depth") <= most_depth)
        edges = jumps.where(f"a{RADIX} is not null").select("project", "version", F.col(f"a{RADIX}").alias("parent"))
        if edges.isEmpty():
            break
        most_steps = jumps.count() if most_steps is None else most_steps
        step *= RADIX
        if step > most_steps:
            raise ValueError("parents of versions go round")
    return rows


def cutoffs(steps: DataFrame, deletions: DataFrame) -> DataFrame:
    """(project, version, path, cutoff): depth of the nearest tombstone of each path."""
    dead = deletions.select("project", F.col("version").alias("anc"), F.col("unit_path").alias("path"))
    return steps.join(dead, ["project", "anc"]).groupBy("project", "version", "path").agg(F.min("depth").alias("cutoff"))


def effective(
    cat: Catalogue, own_level_wins: bool, project: str | None = None, match_container: bool = False, most_depth: int | None = None, wanted: tuple[int, ...] | None = None
) -> DataFrame:
    """(project, version, path, snapshot_id, depth): units a version has, its own or inherited.

    The nearest ancestor's unit counts unless a tombstone hides it. With
    own_level_wins (lookup) a unit stored beside a tombstone of its own version
    stays; without it (diff) the tombstone hides it too. match_container also
    takes units inside archives, whose name isn't their descriptor's path.
    wanted: of these versions only; most_depth: from ancestors no further than
    that, as lookups do.
    """
    versions, descriptors, deletions = cat.versions, cat.descriptors, cat.deletions
    if project is not None:
        versions, descriptors, deletions = (t.where(F.col("project") == project) for t in (versions, descriptors, deletions))
    steps = chain(versions, most_depth, wanted)
    units = descriptors.select(F.col("id").alias("descriptor_id"), "project", F.col("version").alias("anc"), F.col("path").alias("container"))
    units = units.join(cat.snapshots.select(F.col("id").alias("snapshot_id"), "descriptor_id", F.col("unit_name").alias("path")), "descriptor_id")
    if not match_container:
        units = units.where("path = container")
    near = steps.join(units, ["project", "anc"]).groupBy("project", "version", "path")
    near = near.agg(F.min(F.struct("depth", "container", "snapshot_id")).alias("best")).select("project", "version", "path", "best.snapshot_id", "best.depth")
    kept = near.join(cutoffs(steps, deletions), ["project", "version", "path"], "left")
    alive = F.col("cutoff").isNull() | ((F.col("cutoff") >= F.col("depth")) if own_level_wins else (F.col("cutoff") > F.col("depth")))
    return kept.where(alive).select("project", "version", "path", "snapshot_id", "depth")


def removals(cat: Catalogue, project: str, version: int, uploaded: DataFrame) -> DataFrame:
    """(unit_path): what the parent has and ``uploaded`` (path) lacks; nothing without a parent."""
    parent = cat.versions.where((F.col("project") == project) & (F.col("version") == version)).select("project", F.col("parent_version").alias("version"))
    above = tuple(r[0] for r in parent.where("version is not null").select("version").distinct().collect())  # one, or none
    has = effective(cat, True, project, wanted=above or (version,)).join(parent, ["project", "version"], "left_semi").select("path")
    return has.join(uploaded.select("path"), "path", "left_anti").select(F.col("path").alias("unit_path")).distinct()


def next_version(versions: DataFrame) -> DataFrame:
    """(project, next_version)."""
    return versions.groupBy("project").agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def reconcile_counters(counters: DataFrame, versions: DataFrame) -> DataFrame:
    """(project, counter): the greater of a counter and the greatest version, per project; a null project is one as well."""
    top = versions.groupBy("project").agg(F.max("version").alias("top"))
    own = counters.select(F.col("project").alias("_project"), "counter")
    rows = top.join(own, F.col("project").eqNullSafe(F.col("_project")), "left")
    return rows.select("project", F.greatest("top", F.coalesce("counter", F.lit(0))).alias("counter"))


def open_version(versions: DataFrame) -> DataFrame:
    """(project, version, parent_version, is_new): the greatest OPEN version, else the next number above the greatest FINALIZED one."""
    per = versions.groupBy("project").agg(
        F.max(F.when(F.col("status") == "OPEN", F.col("version"))).alias("open"),
        F.max("version").alias("top"),
        F.max(F.when(F.col("status") == "FINALIZED", F.col("version"))).alias("final"),
    )
    old = versions.select("project", F.col("version").alias("open"), "parent_version")
    per = per.join(old, ["project", "open"], "left")
    return per.select(
        "project",
        F.coalesce("open", F.col("top") + 1).alias("version"),
        F.when(F.col("open").isNull(), F.col("final")).otherwise(F.col("parent_version")).alias("parent_version"),
        F.col("open").isNull().alias("is_new"),
    )


def ensure_version(versions: DataFrame, project: str, version: int) -> DataFrame:
    """versions with (project, version) in it, its parent the greatest FINALIZED version below."""
    own = versions.where((F.col("project") == project) & (F.col("version") == version))
    if own.limit(1).count():
        return versions
    top = versions.where((F.col("project") == project) & (F.col("status") == "FINALIZED")).agg(F.max("version")).first()[0]
    if top is not None and top >= version:
        raise ValueError(f"parent {top} isn't below version {version}")
    row = versions.sparkSession.createDataFrame([(project, version, top, "OPEN")], "project string, version int, parent_version int, status string")
    return versions.unionByName(row, allowMissingColumns=True)


def finalise(versions: DataFrame, project: str, version: int) -> DataFrame:
    """versions with (project, version) FINALIZED; LookupError if it is missing, VersionConflict if it was."""
    here = (F.col("project") == project) & (F.col("version") == version)
    row = versions.where(here).select("status").first()
    if row is None:
        raise LookupError(f"no version {version} of {project}")
    if row[0] == "FINALIZED":
        raise VersionConflict(f"version {version} of {project} is finalized")
    return versions.withColumn("status", F.when(here, "FINALIZED").otherwise(F.col("status")))


def delete_unit(versions: DataFrame, deletions: DataFrame, project: str, version: int, path: str) -> DataFrame:
    """deletions with a tombstone more; the same twice is one; a FINALIZED version refuses."""
    if versions.where((F.col("project") == project) & (F.col("version") == version) & (F.col("status") == "FINALIZED")).limit(1).count():
        raise VersionConflict(f"version {version} of {project} is finalized")
    row = deletions.sparkSession.createDataFrame([(project, version, path)], "project string, version int, unit_path string")
    return deletions.select("project", "version", "unit_path").unionByName(row).distinct()


def writable(rows: DataFrame, versions: DataFrame) -> DataFrame:
    """rows (project, version, ...) that may be stored: of versions that aren't FINALIZED; unknown ones are open."""
    return rows.join(versions.where("status = 'FINALIZED'").select("project", "version"), ["project", "version"], "left_anti")
