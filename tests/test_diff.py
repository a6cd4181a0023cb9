"""The diff's scenarios, on a small catalogue."""

import pytest
from pyspark.sql import functions as F

from stratalode.catalog import Catalogue
from stratalode.operators import diff, lookup
from stratalode.operators import versions as V

CORE = ("FIELD_STORE", "CORE", "LOG_MESSAGE", None, "a.B", "run", 3, 0.9)


def catalogue(spark, units, versions=((1, None), (2, 1)), deletions=()):
    """units: (version, path, {value: [usage, ...]}), usages as CORE; container: path before a bar."""
    d, s, c, u = [], [], [], []
    for i, (version, path, values) in enumerate(units):
        container, _, name = path.rpartition("|")
        d.append((i, "p", version, "CLASS_FILE", container or name))
        s.append((i, i, name))
        for k, (value, usages) in enumerate(values.items()):
            c.append((i * 100 + k, i, value, "String"))
            u += [(i * 100 + k, *x, "{}") for x in usages]
    usage = "constant_id long, structural_type string, semantic_type_kind string, semantic_type_name string, semantic_display_name string, location_class_name string, location_method_name string, location_line_number int, confidence double, metadata string"
    make = spark.createDataFrame
    return Catalogue(
        spark,
        make(d, "id long, project string, version int, source_kind string, path string"),
        make(s, "id long, descriptor_id long, unit_name string"),
        make(c, "id long, snapshot_id long, constant_value string, constant_value_type string"),
        make(u, usage),
        make([("p", v, parent, "OPEN" if v == max(x for x, _ in versions) else "FINALIZED") for v, parent in versions], "project string, version int, parent_version int, status string"),
        make([("p", *x) for x in deletions], "project string, version int, unit_path string"),
    )


def changes(cat, old=1, new=2, **options):
    rows = diff.project_diff(cat, "p", old, new, **options).collect()
    return {r.path: (r.added_unit, r.removed_unit, {e.value: e.change_kind for e in r.changed_constants}) for r in rows}


def test_added_constant(spark):
    cat = catalogue(spark, [(1, "A", {"x": [CORE]}), (2, "A", {"x": [CORE], "y": [CORE]})])
    assert changes(cat) == {"A": (False, False, {"y": "ADDED"})}


def test_removed_and_added_units(spark):
    cat = catalogue(spark, [(1, "A", {"x": [CORE]}), (2, "B", {})], deletions=[(2, "A")])
    assert changes(cat) == {"A": (False, True, {"x": "REMOVED"}), "B": (True, False, {})}


def test_inherited_unit_is_unchanged(spark):
    assert changes(catalogue(spark, [(1, "A", {"x": [CORE]})])) == {}


def test_order_of_usages_says_nothing(spark):
    other = ("FIELD_STORE", "CORE", "LOG_MESSAGE", None, "a.B", "stop", 9, 0.9)
    cat = catalogue(spark, [(1, "A", {"x": [CORE, other]}), (2, "A", {"x": [other, CORE]})])
    assert changes(cat) == {}


@pytest.mark.parametrize("place, value", [(0, "ANNOTATION_VALUE"), (2, "SQL_FRAGMENT"), (3, "Shown"), (4, None), (6, None), (7, 0.91)])
def test_each_field_of_a_usage_counts(spark, place, value):
    other = tuple(value if i == place else x for i, x in enumerate(CORE))
    cat = catalogue(spark, [(1, "A", {"x": [CORE]}), (2, "A", {"x": [other]})])
    assert changes(cat) == {"A": (False, False, {"x": "CHANGED"})}


def test_units_in_archives(spark):
    cat = catalogue(spark, [(1, "j.jar|A", {"x": [CORE]}), (2, "j.jar|A", {"y": [CORE]})])
    assert changes(cat) == {"A": (False, False, {"x": "REMOVED", "y": "ADDED"})}
    assert changes(cat, match_container=False) == {}


def test_unknown_version(spark):
    with pytest.raises(LookupError):
        changes(catalogue(spark, [(1, "A", {})]), 1, 7)


def test_canonical_sort(spark):
    rows = [
        ("B", "c", "m", 1, 0.5), ("A", None, "m", 1, 0.5), ("A", "c", None, 1, 0.5), ("A", "c", "m", None, 0.5), ("A", "c", "m", 2, 0.5), ("A", "c", "m", 2, 0.9),
    ]
    df = spark.createDataFrame(rows, "structural_type string, location_class_name string, location_method_name string, location_line_number int, confidence double")
    df = df.withColumns({c: F.lit(None).cast("string") for c in ("semantic_type_kind", "semantic_type_name", "semantic_display_name")})
    got = df.agg(F.sort_array(F.collect_list(diff.canonical_usage())).alias("u")).first().u
    order = [(u.structural_type, u.location_class_name, u.location_method_name, u.location_line_number, u.confidence) for u in got]
    assert order == [rows[1], rows[2], rows[5], rows[4], rows[3], rows[0]]


def test_lookup_and_diff_differ_on_tombstones(spark):
    cat = catalogue(spark, [(1, "A", {"x": [CORE]}), (2, "A", {"y": [CORE]})], deletions=[(2, "A")])
    found = lookup.find_unit(cat, "p", "A", 2).collect()
    assert [r.value for r in found] == ["y"]
    assert V.effective(cat, False, "p").where("version = 2").count() == 0


def test_lookup_inherits(spark):
    cat = catalogue(spark, [(1, "A", {"x": [CORE]})], versions=((1, None), (2, 1), (3, 2)), deletions=[(3, "A")])
    assert lookup.find_key(cat, "p:A:2").count() == 1
    assert lookup.find_key(cat, "p:A:3").count() == 0
    with pytest.raises(ValueError):
        lookup.find_key(cat, "p:A")


def test_version_life(spark):
    cat = catalogue(spark, [(1, "A", {})])
    done = V.finalise(cat.versions, "p", 2)
    with pytest.raises(V.VersionConflict):
        V.finalise(done, "p", 2)
    with pytest.raises(LookupError):
        V.finalise(done, "p", 9)
    with pytest.raises(V.VersionConflict):
        V.delete_unit(done, cat.deletions, "p", 2, "A")
    with pytest.raises(ValueError):
        V.ensure_version(done, "p", 0)
    assert [tuple(r) for r in V.open_version(done).collect()] == [("p", 3, 2, True)]
