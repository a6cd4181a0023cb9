"""Unit listings, usage details and metadata of one project version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalogue
from ..functions import text
from ..schemas import CORE_SEMANTIC_TYPES, STRUCTURAL_TYPES, VALUE_TYPES, core_semantic_types

NO_SUCH_KIND = "__UNKNOWN__"
UNITS_PAGE, DETAILS_PAGE = 50, 100


def page(df: DataFrame, number: int | None, size: int | None, default: int) -> DataFrame:
    """One page of ordered rows: page null is the first, size null the endpoint's default."""
    number, size = number or 0, default if size is None else size
    if number < 0 or size <= 0:
        raise ValueError("page must be 0 or more, and its size more than 0")
    return df.offset(number * size).limit(size)


def resolve_semantic(name: str | None, custom: DataFrame | None = None) -> tuple[str, str] | None:
    """(kind, name): a core type's name, else a custom category, else a kind that no row has."""
    if name is None:
        return None
    if name in {t[0] for t in CORE_SEMANTIC_TYPES}:
        return "CORE", name
    if custom is not None and custom.where(F.col("category") == name).limit(1).count():
        return "CUSTOM", name
    return NO_SUCH_KIND, name


def scoped(cat: Catalogue, project: str, version: int) -> DataFrame:
    """(path, unit_name, snapshot_id) of the version's own units."""
    own = cat.descriptors.where((F.col("project") == project) & (F.col("version") == version)).select(F.col("id").alias("descriptor_id"), "path")
    return own.join(cat.snapshots.withColumnRenamed("id", "snapshot_id"), "descriptor_id").select("path", "unit_name", "snapshot_id")


def usage_filter(structural: str | list[str] | None, semantic: tuple[str, str] | None, value_type: str | list[str] | None) -> tuple[Column, Column]:
    """Predicates on (constants, usages); what is None says nothing. Lists: any of them."""
    on_constant, on_usage = F.lit(True), F.lit(True)
    many = lambda x: x if isinstance(x, list) else [x]
    if value_type is not None:
        on_constant = on_constant & F.col("constant_value_type").isin(many(value_type))
    if structural is not None:
        on_usage = on_usage & F.col("structural_type").isin(many(structural))
    if semantic is not None:
        kind, name = semantic
        # A kind that no row has folds to an empty relation.
        on_usage = on_usage & (F.lit(False) if kind == NO_SUCH_KIND else (F.col("semantic_type_kind") == kind) & F.col("semantic_type_name").isin(many(name)))
    return on_constant, on_usage


def unit_counts(cat: Catalogue, project: str, version: int, structural=None, semantic=None, value_type=None) -> DataFrame:
    """(path, unit_name, n): distinct constants of each unit that have a usage the filters let pass."""
    on_constant, on_usage = usage_filter(structural, semantic, value_type)
    constants = cat.constants.where(on_constant).select(F.col("id").alias("constant_id"), "snapshot_id")
    usages = cat.usages.where(on_usage).select("constant_id")
    rows = scoped(cat, project, version).join(constants, "snapshot_id").join(usages, "constant_id")
    return rows.groupBy("path", "unit_name").agg(F.countDistinct("constant_id").alias("n"))


def all_unit_counts(cat: Catalogue, project: str, version: int) -> DataFrame:
    """(path, unit_name, n) of all units; those without constants have 0."""
    constants = cat.constants.select(F.col("id").alias("constant_id"), "snapshot_id")
    return scoped(cat, project, version).join(constants, "snapshot_id", "left").groupBy("path", "unit_name").agg(F.count("constant_id").alias("n"))


def listing(counts: DataFrame) -> DataFrame:
    """(unit_path, units): names and counts per path, ordered by name."""
    units = F.sort_array(F.collect_list(F.struct(F.col("unit_name").alias("name"), F.col("n").alias("constants"))))
    return counts.groupBy(F.col("path").alias("unit_path")).agg(units.alias("units"))


def usage_details(cat: Catalogue, project: str, version: int, structural=None, semantic=None, value_type=None) -> DataFrame:
    """How often each (value, type, usage, semantics, confidence, metadata) occurs in the version's units."""
    on_constant, on_usage = usage_filter(structural, semantic, value_type)
    constants = cat.constants.where(on_constant).join(scoped(cat, project, version), "snapshot_id", "left_semi")
    rows = constants.select(F.col("id").alias("constant_id"), "constant_value", "constant_value_type").join(cat.usages.where(on_usage), "constant_id")
    return rows.groupBy("constant_value", "constant_value_type", "structural_type", "semantic_type_name", "confidence", "metadata").agg(F.count(F.lit(1)).alias("n"))


def details_order() -> list[Column]:
    """Most frequent first; nulls last, as SQL has them."""
    columns = ("constant_value", "constant_value_type", "structural_type", "semantic_type_name", "confidence", "metadata")
    return [F.desc("n"), *[F.asc_nulls_last(c) for c in columns]]


def custom_types(cat: Catalogue) -> DataFrame:
    """Names of custom semantic types in use."""
    return cat.usages.where((F.col("semantic_type_kind") == "CUSTOM") & text.not_blank(F.col("semantic_type_name"))).select("semantic_type_name").distinct()


def value_types_in_use(cat: Catalogue) -> DataFrame:
    return cat.constants.where(text.not_blank(F.col("constant_value_type"))).select("constant_value_type").distinct()


def register_types(rows: DataFrame) -> DataFrame:
    """(category, display_name, description) of registrations (seq, ...): categories in normal form, the first one stays."""
    plain = rows.withColumn("category", text.category(F.col("category"))).where("category is not null")
    return plain.groupBy("category").agg(F.min_by(F.struct("display_name", "description"), "seq").alias("r")).select("category", "r.*")


def metadata(spark: SparkSession, custom: DataFrame) -> dict[str, DataFrame]:
    """What can be asked for: value types by name, usages in their own order, semantic types by display name."""
    types = spark.createDataFrame([(t,) for t in sorted(VALUE_TYPES)], "name string").withColumn("display_name", F.col("name"))
    structural = spark.createDataFrame(list(enumerate(STRUCTURAL_TYPES)), "place int, name string").withColumn("display_name", text.humanise(F.col("name")))
    core = core_semantic_types(spark).select("name", "display_name")
    semantic = core.unionByName(custom.select(F.col("semantic_type_name").alias("name"), F.col("semantic_type_name").alias("display_name"))).distinct()
    return {"types": types, "structural": structural.orderBy("place").drop("place"), "semantic": semantic.orderBy(F.lower("display_name"), "name")}


def shared_constants(cat: Catalogue) -> DataFrame:
    """Values that stand in more than one project."""
    rows = cat.constants.select("snapshot_id", "constant_value").join(cat.snapshots.select(F.col("id").alias("snapshot_id"), "descriptor_id"), "snapshot_id")
    rows = rows.join(cat.descriptors.select(F.col("id").alias("descriptor_id"), "project"), "descriptor_id")
    return rows.groupBy("constant_value").agg(F.countDistinct("project").alias("projects")).where("projects > 1")


def merge_badges(pairs: DataFrame) -> DataFrame:
    """(value, semantic): semantic badges (seq, value, semantic) without repeats; Unknown goes where there is another."""
    one = pairs.groupBy("value", "semantic").agg(F.min("seq").alias("seq"))
    known = one.groupBy("value").agg(F.max(F.col("semantic") != "Unknown").alias("known"))
    return one.join(known, "value").where(~F.col("known") | (F.col("semantic") != "Unknown")).select("value", "semantic")
