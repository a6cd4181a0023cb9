"""Extraction: files to usage rows, one task per split of files; a file that fails gives a row with its error."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.classify import ANNOTATION_RULES, CALL_RULES
from ..schemas import USAGE
from . import archives, config_files
from .class_file import BadClass, ClassFile, Constant, internal_name, java_descriptor, written
from .interpreter import method_usages

FIELDS = [f.split()[0] for f in USAGE.split(", ")]


def binary_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, content, size_bytes, content_hash) of files; glob picks them by name."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "content", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("content_hash"))


def kind_of(path: str) -> str | None:
    name = path.lower()
    rules = ((".class", "CLASS_FILE"), ((".yml", ".yaml"), "YAML"), (".properties", "PROPERTIES"), ((".jar", ".zip"), "JAR"))
    return next((kind for ends, kind in rules if name.endswith(ends)), None)


def _matches(name: str, patterns: tuple[str, ...]) -> bool:
    return any(name.endswith(p[1:]) if p.startswith("%") else name == p for p in patterns)


def call_semantics(owner: str, method: str, descriptor: str) -> list[tuple[str, float, dict]]:
    """(semantic type, confidence, metadata) of each rule that fits a call."""
    out = []
    for semantic, keys, parts in CALL_RULES.values():
        for classes, methods, confidence in parts:
            if method in methods and _matches(owner, classes):
                out.append((semantic, confidence, {keys[0]: owner, keys[1]: method, "methodDescriptor": descriptor}))
                break
    return out


def annotation_semantics(annotation: str, element: str) -> tuple[str, float] | None:
    return next(((semantic, confidence) for names, elements, semantic, confidence in ANNOTATION_RULES if annotation in names and (not elements or element in elements)), None)


def class_usages(content: bytes, path: str) -> Iterator[dict]:
    """Usage rows of a class file: annotations, static final fields, code."""
    cf = ClassFile(content)
    name = internal_name(cf.name)

    def row(c: Constant, structural: str, semantic: str, confidence: float, method: str, descriptor: str, offset, line, metadata: dict) -> dict:
        return dict(
            path=path, source_kind="CLASS_FILE", unit_name=name, value=written(c), value_type=c.tag, structural_type=structural, semantic_type=semantic, confidence=confidence,
            class_name=name, method_name=method, method_descriptor=descriptor, bytecode_offset=offset, line_number=line, metadata=json.dumps(metadata, ensure_ascii=True), error=None,
        )

    noted = [("<class>", "()void", "CLASS", cf.annotations)]
    noted += [(f"<field:{f.name}>", java_descriptor(f.descriptor), "FIELD", f.annotations) for f in cf.fields]
    for m in cf.methods:
        noted += [(m.name, java_descriptor(m.descriptor), "METHOD", m.annotations), (m.name, java_descriptor(m.descriptor), "PARAMETER", m.parameter_annotations)]
    for method, descriptor, target, found in noted:
        for annotation, element, c in found:
            semantic, confidence = annotation_semantics(annotation, element) or ("UNKNOWN", 0.0)
            metadata = {"annotationDescriptor": annotation, "elementName": element, "targetKind": target}
            yield row(c, "ANNOTATION_VALUE", semantic, confidence, method, descriptor, 0, None, metadata)
    for f in cf.fields:
        if f.flags & 0x18 == 0x18 and f.constant is not None:
            metadata = {"fieldOwner": name, "fieldName": f.name, "fieldDescriptor": f.descriptor, "receiverKind": "STATIC"}
            yield row(f.constant, "STATIC_FIELD_STORE", "UNKNOWN", 0.0, f"<field:{f.name}>", f.descriptor, None, 0, metadata)
    for m in cf.methods:
        if m.code is None:
            continue
        usages, truncated = method_usages(cf, m)
        descriptor = java_descriptor(m.descriptor)
        for u in usages:
            said = call_semantics(*u.callee, u.context["calleeDescriptor"]) if u.callee else []
            for semantic, confidence, metadata in said or [("UNKNOWN", 0.0, u.context)]:
                yield row(u.constant, u.structural, semantic, confidence, m.name, descriptor, u.offset, u.line, metadata | ({"truncated": "true"} if truncated else {}))


def config_usages(content: bytes, path: str, kind: str) -> Iterator[dict]:
    rows = config_files.yaml_values(content) if kind == "YAML" else ((k, v, "properties") for k, v in config_files.properties_values(content))
    for key, value, doc in rows:
        tag = {bool: "Boolean", int: "Integer", float: "Double", str: "String"}.get(type(value), type(value).__name__)
        if tag == "Integer" and not -(2**31) <= value < 2**31:
            tag = "Long" if -(2**63) <= value < 2**63 else "BigInteger"
        text = written(Constant(tag, value))
        yield dict(
            path=path, source_kind=kind, unit_name=path, value=text, value_type=tag, structural_type="FIELD_STORE", semantic_type=config_files.classify(value, key), confidence=0.9,
            class_name=path, method_name=key, method_descriptor=doc, bytecode_offset=None, line_number=0, metadata=json.dumps({"keyPath": key}, ensure_ascii=True), error=None,
        )


def file_usages(path: str, content: bytes, kind: str | None = None) -> Iterator[dict]:
    """Usage rows of one file of any kind; an archive's entries each on their own. No extractor, no rows."""
    kind = kind or kind_of(path)
    try:
        if kind == "CLASS_FILE":
            yield from list(class_usages(content, path))
        elif kind in ("YAML", "PROPERTIES"):
            yield from list(config_usages(content, path, kind))
        elif kind == "JAR":
            for e in archives.entries(path, content):
                if e.error:
                    yield failed(e.container, kind, e.error)
                elif kind_of(e.path) not in (None, "JAR"):
                    for row in file_usages(e.path, e.content):
                        yield row | {"path": f"{e.container}!{e.path}"}
    except (BadClass, ValueError, KeyError, IndexError) as e:
        yield failed(path, kind, f"{type(e).__name__}: {e}")
    except Exception as e:  # a YAML reader's own kinds
        yield failed(path, kind, f"{type(e).__name__}: {e}")


def failed(path: str, kind: str | None, error: str) -> dict:
    return dict.fromkeys(FIELDS) | {"path": path, "source_kind": kind, "error": error[:500]}


def extract(files: DataFrame, rows_a_batch: int = 5_000) -> DataFrame:
    """Usage rows (schemas.USAGE) of files (path, content)."""
    arrow = to_arrow_schema(StructType.fromDDL(USAGE))

    def run(batches):
        held: list[dict] = []
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in file_usages(path, content or b""):
                    held.append(row)
                    if len(held) >= rows_a_batch:
                        yield pa.RecordBatch.from_pylist(held, arrow)
                        held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, arrow)

    return files.select("path", "content").mapInArrow(run, USAGE)


def archive_entries(files: DataFrame, ignore_prefix: str | None = None) -> DataFrame:
    """(container, depth, path, content, content_hash, error) of the entries of archives (path, content)."""

    def run(batches):
        names = ["container", "depth", "path", "content", "error"]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for e in archives.entries(path, content or b"", ignore_prefix):
                    columns = [pa.array([e.container]), pa.array([e.depth], pa.int32()), pa.array([e.path]), pa.array([e.content], pa.binary()), pa.array([e.error], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    out = files.select("path", "content").mapInArrow(run, "container string, depth int, path string, content binary, error string")
    return out.withColumn("content_hash", F.sha2("content", 256))


def counters(usages: DataFrame) -> DataFrame:
    """(outcome, files): files that gave rows, and failures by kind of error."""
    outcome = F.coalesce(F.regexp_extract("error", "^([A-Za-z]+)", 1), F.lit("processed"))
    return usages.select("path", outcome.alias("outcome")).distinct().groupBy("outcome").agg(F.count(F.lit(1)).alias("files"))


def catalogue_rows(usages: DataFrame, project: str, version: int | Column) -> dict[str, DataFrame]:
    """The four catalogue tables of extracted usages; ids are hashes of their keys. version: a number, or the column that holds it."""
    fine = usages.where("error is null").withColumn("container", F.substring_index("path", "!", 1)).withColumns({"project": F.lit(project), "version": F.lit(version)})
    fine = fine.withColumn("descriptor_id", F.xxhash64("project", "version", "container")).withColumn("snapshot_id", F.xxhash64("descriptor_id", "unit_name"))
    fine = fine.withColumn("constant_id", F.xxhash64("snapshot_id", "value", "value_type"))
    core = F.when(F.col("semantic_type").isNotNull(), "CORE")
    return {
        "unit_descriptors": fine.groupBy(F.col("descriptor_id").alias("id"), "project", "version", F.col("container").alias("path")).agg(F.min("source_kind").alias("source_kind")),
        "unit_snapshots": fine.select(F.col("snapshot_id").alias("id"), "descriptor_id", "unit_name").distinct(),
        "unit_constants": fine.select(F.col("constant_id").alias("id"), "snapshot_id", F.col("value").alias("constant_value"), F.col("value_type").alias("constant_value_type")).distinct(),
        "constant_usages": fine.select(
            "constant_id", "structural_type", core.alias("semantic_type_kind"), F.col("semantic_type").alias("semantic_type_name"), F.col("class_name").alias("location_class_name"),
            F.col("method_name").alias("location_method_name"), F.col("method_descriptor").alias("location_method_descriptor"), F.col("bytecode_offset").alias("location_bytecode_offset"),
            F.col("line_number").alias("location_line_number"), "confidence", "metadata",
        ).distinct(),
    }


def seed(files: DataFrame, project: str) -> dict[str, DataFrame]:
    """The catalogue's tables, versions and tombstones too, when the archives (path, content, version) are stored version by version.

    An archive is the unit of its file name; each version is synchronised (what
    the one before it has and it lacks gets a tombstone) and finalised.
    """
    name = F.substring_index("path", "/", -1)
    jars = files.where(F.lower(name).endswith(".jar")).select(F.concat_ws("/", F.col("version").cast("string"), name).alias("path"), "content")
    usages = extract(jars).withColumn("version", F.substring_index("path", "/", 1).cast("int")).withColumn("path", F.regexp_replace("path", "^[^/]*/", ""))
    tables = catalogue_rows(usages, project, F.col("version"))
    stored = jars.select(F.substring_index("path", "/", 1).cast("int").alias("version"), F.substring_index("path", "/", -1).alias("unit_path")).distinct()
    by_number = Window.orderBy("version")  # one row a version of one project
    versions = stored.select("version").distinct().withColumns({"parent_version": F.lag("version").over(by_number), "next_version": F.lead("version").over(by_number)})
    tables["project_versions"] = versions.select(F.lit(project).alias("project"), "version", "parent_version", F.lit("FINALIZED").alias("status"))
    before = stored.join(versions.where("next_version is not null"), "version").select(F.col("next_version").alias("version"), "unit_path")
    tables["version_deletions"] = before.join(stored, ["version", "unit_path"], "left_anti").select(F.lit(project).alias("project"), "version", "unit_path")
    return tables
