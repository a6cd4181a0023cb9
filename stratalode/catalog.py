"""The catalogue: its tables as DataFrames, and the views that shape the test tables like one."""

from __future__ import annotations

import threading
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations", "embeddings")

#: Views over the test tables, in order of dependence; the text runs in Spark and in DuckDB.
VIEWS = {
    "project_versions": """SELECT r_name AS project, v AS version, CASE WHEN v>1 THEN v-1 END AS parent_version,
 CASE WHEN v<7 THEN 'FINALIZED' ELSE 'OPEN' END AS status FROM region CROSS JOIN (VALUES (1),(2),(3),(4),(5),(6),(7)) t(v)""",
    "unit_descriptors": """SELECT s_suppkey*100+v AS id, r_name AS project, v AS version, 'CLASS_FILE' AS source_kind, s_name AS path
 FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey
 CROSS JOIN (VALUES (1),(2),(3),(4),(5),(6),(7)) t(v) WHERE (s_suppkey+v)%3<>0""",
    "unit_snapshots": "SELECT id, id AS descriptor_id, path AS unit_name FROM unit_descriptors",
    "version_deletions": """SELECT r_name AS project, v AS version, s_name AS unit_path
 FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey
 CROSS JOIN (VALUES (1),(2),(3),(4),(5),(6),(7)) t(v) WHERE (s_suppkey+2*v)%11=0""",
    "unit_constants": """SELECT DISTINCT s.id*1000000+l_partkey AS id, s.id AS snapshot_id, p_name AS constant_value,
 CASE p_size%4 WHEN 0 THEN 'String' WHEN 1 THEN 'Integer' WHEN 2 THEN 'Long' ELSE 'Double' END AS constant_value_type
 FROM lineitem JOIN unit_snapshots s ON s.id=l_suppkey*100+(year(l_shipdate)-1994) JOIN part ON p_partkey=l_partkey""",
    "constant_usages": """SELECT c.id AS constant_id,
 CASE l_linenumber%7 WHEN 0 THEN 'ARITHMETIC_OPERAND' WHEN 1 THEN 'METHOD_INVOCATION_PARAMETER' WHEN 2 THEN 'FIELD_STORE' WHEN 3 THEN 'STATIC_FIELD_STORE' WHEN 4 THEN 'STRING_CONCATENATION_MEMBER' WHEN 5 THEN 'METHOD_INVOCATION_TARGET' ELSE 'ANNOTATION_VALUE' END AS structural_type,
 CASE WHEN l_returnflag='N' AND l_linestatus='F' THEN 'CUSTOM' ELSE 'CORE' END AS semantic_type_kind,
 CASE l_returnflag||l_linestatus WHEN 'AF' THEN 'SQL_FRAGMENT' WHEN 'AO' THEN 'URL_RESOURCE' WHEN 'RF' THEN 'LOG_MESSAGE' WHEN 'RO' THEN 'ERROR_MESSAGE' WHEN 'NO' THEN 'UNKNOWN' ELSE 'feature_flag' END AS semantic_type_name,
 p_brand AS location_method_name, CASE WHEN l_orderkey%10=0 THEN NULL ELSE l_orderkey%500 END AS location_line_number,
 l_discount AS confidence, '{"calleeOwner":"'||p_brand||'"}' AS metadata
 FROM lineitem JOIN unit_constants c ON c.id=(l_suppkey*100+(year(l_shipdate)-1994))*1000000+l_partkey JOIN part ON p_partkey=l_partkey""",
}


def with_views(sql: str, recursive: bool = False) -> str:
    """SQL with the views that it names, as CTEs in front."""
    wanted: set[str] = set()

    def need(text: str) -> None:
        for name, body in VIEWS.items():
            if name in text and name not in wanted:
                wanted.add(name)
                need(body)

    need(sql)
    ctes = [f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in wanted]
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        recursive, body = True, body[15:]
        ctes.append(body)
        return "WITH RECURSIVE " + ", ".join(ctes)
    if body.upper().startswith("WITH "):
        ctes.append(body[5:])
        return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(ctes)
    return (f"WITH {', '.join(ctes)} " if ctes else "") + body


#: where the catalogue over a folder of test tables stands, by application, and the tables that are written there
_roots: dict[tuple[str, str], str] = {}
_written: dict[str, set[str]] = {}
_writing = threading.RLock()
#: How the large tables are laid out: in folders by a hash of the unit's snapshot,
#: in the order of what they are joined by, with bloom filters on what they are looked up by.
BUCKETS = 64  # as many as a long has bits
SLICE_ROWS = 1_000_000  # rows of line items for each slice of a folder
LOOKED_UP = {"unit_descriptors": ("path",), "unit_snapshots": ("unit_name", "descriptor_id"), "unit_constants": ("snapshot_id",), "constant_usages": ("constant_id",)}
SORTED = {"unit_descriptors": ("project", "version", "path"), "unit_snapshots": ("unit_name", "descriptor_id"), "unit_constants": ("snapshot_id", "id"), "constant_usages": ("constant_id",)}


def bucket_of(snapshot_id: Column) -> Column:
    """The folder that a unit's constants and usages stand in."""
    return F.pmod(F.xxhash64(snapshot_id.cast("long")), F.lit(BUCKETS)).cast("int")


def _beside_constants(usages: DataFrame, constants: DataFrame) -> DataFrame:
    """usages with the ``bucket`` of their constant's unit.

    Where several units share a constant's id, its usages stand in the folder
    of each, in all but the first as a ``copy``: a scan leaves copies out, so
    that each usage counts once.
    """
    folders = constants.groupBy(F.col("id").alias("constant_id")).agg(F.min("bucket").alias("_first"), F.bit_or(F.expr("shiftleft(1L, bucket)")).alias("_all"))
    others = F.filter(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: (b != F.col("_first")) & (F.getbit(F.col("_all"), b) == 1))
    places = F.when(F.bit_count("_all") == 1, F.array("_first")).otherwise(F.concat(F.array("_first"), others))
    rows = usages.join(folders, "constant_id").select(*usages.columns, F.posexplode(places).alias("_nth", "bucket"))
    return rows.withColumn("copy", F.col("_nth") > 0).drop("_nth")


def _write_table(name: str, rows: DataFrame, root: str, placed: bool = False) -> None:
    """placed: rows stand in tasks by folder already."""
    from .operators.store import clear, names

    by = ("bucket",) if "bucket" in rows.columns else ()
    if name in SORTED:
        rows = (rows if placed else rows.repartitionByRange(*by, *SORTED[name])).sortWithinPartitions(*by, *SORTED[name])
    writer = rows.write.partitionBy(*by)
    for column in LOOKED_UP.get(name, ()):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(f"{root}/{name}")
    if by and not any(folder.startswith("bucket=") for folder in names(rows.sparkSession, f"{root}/{name}")):
        clear(rows, f"{root}/{name}")  # no rows make no folders; a file without rows tells the columns


def _in_folders(rows: DataFrame, id_col: str, slices: int) -> DataFrame:
    """rows in tasks by ``bucket`` and ``_slice`` of their ids; nothing is sampled for ranges, so the rows are made once."""
    return rows.withColumn("_slice", F.pmod(F.xxhash64(id_col), F.lit(slices))).repartition("bucket", "_slice")


def write_tables(frames: dict[str, DataFrame], root: str) -> None:
    """Writes a catalogue's tables under a folder, laid out for lookups by unit and for scans alike."""
    frames = dict(frames)
    constants = frames["unit_constants"].withColumn("bucket", bucket_of(F.col("snapshot_id")))
    if "constant_usages" in frames:
        frames["constant_usages"] = _beside_constants(frames["constant_usages"], constants)
    frames["unit_constants"] = constants
    for name, rows in frames.items():
        _write_table(name, rows, root)


def _read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{root}/{name}")
    return rows.where("not copy").drop("copy", "bucket") if name == "constant_usages" else rows.drop("bucket")


#: What each view is made of.
BASES = {
    "project_versions": ("region",),
    "unit_descriptors": ("region", "nation", "supplier"),
    "unit_snapshots": ("unit_descriptors",),
    "version_deletions": ("region", "nation", "supplier"),
    "unit_constants": ("part", "lineitem", "unit_snapshots"),
    "constant_usages": ("part", "lineitem", "unit_constants"),
}


def _root(spark: SparkSession, sf_dir: str) -> str:
    from .operators.store import work_folder

    with _writing:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in _roots:
            _roots[key] = work_folder(spark, "catalogue")
        return _roots[key]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the catalogue's tables over the test tables; it is written when it is first asked for, from those written before."""
    root = _root(spark, sf_dir)
    with _writing:
        if name not in _written.setdefault(root, set()):
            for base in BASES[name]:
                rows = _table(spark, sf_dir, base) if base in VIEWS else spark.read.parquet(f"{sf_dir}/{base}.parquet")
                rows.createOrReplaceTempView(base)
            facts = "lineitem" in BASES[name]
            slices = 1 + spark.table("lineitem").count() // (BUCKETS * SLICE_ROWS) if facts else 1
            if name == "unit_constants":  # the shuffle that puts rows into place serves to make them distinct too
                repeated = spark.sql(VIEWS[name].replace("SELECT DISTINCT", "SELECT", 1)).withColumn("bucket", bucket_of(F.col("snapshot_id")))
                rows = _in_folders(repeated, "id", slices).distinct().drop("_slice")
            else:
                rows = spark.sql(VIEWS[name])
            if name == "constant_usages":
                rows = _in_folders(_beside_constants(rows, spark.read.parquet(f"{root}/unit_constants")), "constant_id", slices).drop("_slice")
            _write_table(name, rows, root, placed=facts)
            _written[root].add(name)
    return _read_table(spark, root, name)


@dataclass
class Catalogue:
    """The catalogue's tables. Reads are lazy; a query reads the columns and partitions that it needs."""

    spark: SparkSession
    descriptors: DataFrame
    snapshots: DataFrame
    constants: DataFrame
    usages: DataFrame
    versions: DataFrame
    deletions: DataFrame
    root: str | None = None

    @classmethod
    def at(cls, spark: SparkSession, root: str) -> Catalogue:
        """The catalogue written under a folder (see operators.store)."""
        names = ("unit_descriptors", "unit_snapshots", "unit_constants", "constant_usages", "project_versions", "version_deletions")
        return cls(spark, *[_read_table(spark, root, n) for n in names], root)

    def of_unit(self, snapshot_id: int) -> tuple[DataFrame, DataFrame]:
        """(constants, usages) of the folder that a unit stands in: its own, and those of others there; all where tables aren't in folders."""
        constants, usages = self.constants, self.usages  # written, if they weren't
        if self.root is None:
            return constants, usages
        bucket = self.spark.range(1).select(bucket_of(F.lit(snapshot_id))).first()[0]
        return tuple(self.spark.read.parquet(f"{self.root}/{n}").where(F.col("bucket") == bucket).drop("bucket", "copy") for n in ("unit_constants", "constant_usages"))

    @classmethod
    def over(cls, spark: SparkSession, sf_dir: str) -> Catalogue:
        """The test tables, shaped like a catalogue; each of its tables is written once a session, when it is first asked for."""
        cat = cls.__new__(cls)
        cat.spark, cat.root, cat._sf_dir = spark, _root(spark, sf_dir), sf_dir
        return cat

    def __getattr__(self, name: str):
        """A table that isn't there yet."""
        if name not in SHAPED or "_sf_dir" not in self.__dict__:
            raise AttributeError(name)
        rows = _table(self.spark, self._sf_dir, SHAPED[name])
        if name == "usages":
            rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("semantic_display_name", "location_class_name")})
        setattr(self, name, rows)
        return rows


#: The view of each of the catalogue's tables.
SHAPED = {"descriptors": "unit_descriptors", "snapshots": "unit_snapshots", "constants": "unit_constants", "usages": "constant_usages", "versions": "project_versions", "deletions": "version_deletions"}
