"""What changed between two versions of a project: units, constants, usages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalogue
from . import versions as V

MAX_INT = 2**31 - 1
#: The fields that make a usage the same in both versions.
IDENTITY = ("structural_type", "semantic_type_kind", "semantic_type_name", "semantic_display_name", "location_class_name", "location_method_name", "location_line_number", "confidence")


def canonical_usage() -> Column:
    """A usage as a struct that sorts in canonical order: by type, class, method, line (none last), confidence downwards, then the rest."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.struct(
        text("structural_type").alias("k1"),
        text("location_class_name").alias("k2"),
        text("location_method_name").alias("k3"),
        F.coalesce(F.col("location_line_number").cast("long"), F.lit(MAX_INT).cast("long")).alias("k4"),
        (-F.col("confidence")).alias("k5"),
        text("semantic_type_kind").alias("k6"),
        text("semantic_type_name").alias("k7"),
        text("semantic_display_name").alias("k8"),
        *[F.col(c).alias(c) for c in IDENTITY],
    )


def unit_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """(path, from_snapshot, to_snapshot, category): ADDED, REMOVED, CHANGED (another snapshot) or SAME."""
    a = left.select("path", F.col("snapshot_id").alias("from_snapshot"))
    b = right.select("path", F.col("snapshot_id").alias("to_snapshot"))
    category = (
        F.when(F.col("from_snapshot").isNull(), "ADDED")
        .when(F.col("to_snapshot").isNull(), "REMOVED")
        .when(F.col("from_snapshot") != F.col("to_snapshot"), "CHANGED")
        .otherwise("SAME")
    )
    return a.join(b, "path", "full_outer").withColumn("category", category)


def effective_pair(cat: Catalogue, project: str, old: int, new: int, match_container: bool = True) -> DataFrame:
    """unit_matches of two versions of a project; LookupError if one is unknown."""
    known = {r[0] for r in cat.versions.where((F.col("project") == project) & F.col("version").isin(old, new)).select("version").distinct().collect()}
    if not {old, new} <= known:
        raise LookupError(f"{project} has no version {sorted({old, new} - known)}")
    units = V.effective(cat, False, project, match_container, wanted=(old, new))
    return unit_matches(units.where(F.col("version") == old), units.where(F.col("version") == new))


def usages_by_value(cat: Catalogue, wanted: DataFrame, snapshot: str, as_: str) -> DataFrame:
    """(path, value, as_): the canonical usage list of each value of the wanted snapshots."""
    of = wanted.where(F.col(snapshot).isNotNull()).select("path", F.col(snapshot).alias("snapshot_id"))
    constants = of.join(cat.constants.select(F.col("id").alias("constant_id"), "snapshot_id", F.col("constant_value").alias("value")), "snapshot_id")
    rows = constants.join(cat.usages.select("constant_id", canonical_usage().alias("u")), "constant_id")
    return rows.groupBy("path", "value").agg(F.sort_array(F.collect_list("u")).alias(as_))


def constant_diff(cat: Catalogue, matches: DataFrame) -> DataFrame:
    """(path, category, value, change_kind, from_usages, to_usages) of the values whose canonical usages differ."""
    touched = matches.where("category <> 'SAME'")  # equal snapshots are left out before the fact tables are read
    a = usages_by_value(cat, touched, "from_snapshot", "f")
    b = usages_by_value(cat, touched, "to_snapshot", "t")
    both = a.join(b, ["path", "value"], "full_outer").where(~F.col("f").eqNullSafe(F.col("t")))
    kind = F.when(F.col("f").isNull(), "ADDED").when(F.col("t").isNull(), "REMOVED").otherwise("CHANGED")
    plain = lambda c: F.transform(F.coalesce(c, F.array().cast(both.schema["f"].dataType)), lambda u: F.struct(*[u[i].alias(i) for i in IDENTITY]))
    rows = both.select("path", "value", kind.alias("change_kind"), plain(F.col("f")).alias("from_usages"), plain(F.col("t")).alias("to_usages"))
    return rows.join(touched.select("path", "category"), "path")


def project_diff(cat: Catalogue, project: str, old: int, new: int, match_container: bool = True) -> DataFrame:
    """(path, added_unit, removed_unit, changed_constants) of the units that differ; a changed unit without changed constants is left out."""
    matches = effective_pair(cat, project, old, new, match_container)
    entry = F.struct("value", F.lit(None).cast("string").alias("value_type"), "from_usages", "to_usages", "change_kind")
    entries = constant_diff(cat, matches).groupBy("path").agg(F.sort_array(F.collect_list(entry)).alias("changed_constants"))
    units = matches.where("category <> 'SAME'").select("path", "category").join(entries, "path", "left")
    units = units.where("category <> 'CHANGED' or changed_constants is not null")
    empty = F.array().cast(units.schema["changed_constants"].dataType)
    return units.select(
        "path", (F.col("category") == "ADDED").alias("added_unit"), (F.col("category") == "REMOVED").alias("removed_unit"), F.coalesce("changed_constants", empty).alias("changed_constants")
    )


def tally(entries: DataFrame) -> DataFrame:
    """(path, added, removed, changed): entries of each kind."""
    kind = lambda k: F.count_if(F.col("change_kind") == k).alias(k.lower())
    return entries.groupBy("path").agg(kind("ADDED"), kind("REMOVED"), kind("CHANGED"))


def only(entries: DataFrame, what: str = "all") -> DataFrame:
    """Entries that a viewer asks for: all, added, removed or changed."""
    return entries if what == "all" else entries.where(F.col("change_kind") == what.upper())
