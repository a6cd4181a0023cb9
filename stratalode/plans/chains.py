"""Queries over chains of 10, 60 and 5000 versions, one version an order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import Catalogue
from ..operators import versions as V
from .registry import query

LENGTHS = (10, 60, 5000)
#: Views over orders; the text runs in Spark and in DuckDB.
VIEWS = {
    "chained": f"SELECT o.*, n, 'chain'||n AS project, o_orderkey+1 AS version FROM orders o CROSS JOIN (VALUES {', '.join(f'({n})' for n in LENGTHS)}) t(n) WHERE o_orderkey < n",
    "deep_versions": "SELECT project, version, CASE WHEN version>1 THEN version-1 END AS parent_version, 'FINALIZED' AS status FROM chained",
    "deep_units": "SELECT CAST(n AS BIGINT)*100000000+o_orderkey AS id, project, version, 'CLASS_FILE' AS source_kind, 'unit'||o_custkey AS path FROM chained",
    "deep_deletions": "SELECT project, version, 'unit'||((o_custkey*7+3)%1500) AS unit_path FROM chained WHERE o_orderkey%9=0",
}
CTES = ", ".join(f"{name} AS ({body})" for name, body in VIEWS.items())
LAST = "last AS (SELECT project, max(version) AS version FROM deep_versions GROUP BY project)"
CHAIN = """chain(project,version,anc,depth) AS (SELECT project, version, version, 0 FROM last
 UNION ALL SELECT c.project, c.version, p.parent_version, c.depth+1 FROM chain c JOIN deep_versions p ON p.project=c.project AND p.version=c.anc WHERE p.parent_version IS NOT NULL{bound})"""
EFFECTIVE = """WITH RECURSIVE {ctes}, {last}, {chain},
 cut AS (SELECT c.project, unit_path, min(depth) AS cutoff FROM chain c JOIN deep_deletions x ON x.project=c.project AND x.version=c.anc GROUP BY ALL),
 near AS (SELECT c.project, c.version, path, min(depth) AS depth, arg_min(id, depth) AS snapshot_id FROM chain c JOIN deep_units d ON d.project=c.project AND d.version=c.anc GROUP BY ALL)
 SELECT n.project, n.version, n.path, n.snapshot_id, n.depth FROM near n LEFT JOIN cut t ON t.project=n.project AND t.unit_path=n.path WHERE cutoff IS NULL OR cutoff {op} n.depth"""


def _sql(op: str, bound: str = "") -> str:
    return EFFECTIVE.format(ctes=CTES, last=LAST, chain=CHAIN.format(bound=bound), op=op)


def _catalogue(spark, sf_dir) -> tuple[Catalogue, tuple[int, ...]]:
    """The chains as a catalogue without constants, and the last version of each."""
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("orders")
    frames = {name: spark.sql(f"WITH {CTES} SELECT * FROM {name}") for name in VIEWS}
    units = frames["deep_units"]
    snapshots = units.select("id", F.col("id").alias("descriptor_id"), F.col("path").alias("unit_name"))
    ends = tuple(r[0] for r in frames["deep_versions"].groupBy("project").agg(F.max("version")).select("max(version)").collect())  # one a chain
    return Catalogue(spark, units, snapshots, None, None, frames["deep_versions"], frames["deep_deletions"]), ends


def _last(rows, cat):
    """rows of the chains' last versions."""
    return rows.join(cat.versions.groupBy("project").agg(F.max("version").alias("version")), ["project", "version"], "left_semi")


@query("J11_deep_ancestors", f"WITH RECURSIVE {CTES}, {LAST}, {CHAIN.format(bound='')} SELECT * FROM chain")
def _(spark, sf_dir):
    cat, ends = _catalogue(spark, sf_dir)
    return _last(V.chain(cat.versions, wanted=ends), cat)


@query("V07_W01_deep_diff", _sql(">"))
def _(spark, sf_dir):
    """What the last versions have for a diff: inherited from any depth."""
    cat, ends = _catalogue(spark, sf_dir)
    return _last(V.effective(cat, False, wanted=ends), cat).select("project", "version", "path", "snapshot_id", "depth")


@query("V06_deep_find", _sql(">=", " AND c.depth<50"))
def _(spark, sf_dir):
    """What lookups in the last versions find: inherited over at most 50 parents."""
    cat, ends = _catalogue(spark, sf_dir)
    return _last(V.effective(cat, True, most_depth=V.MOST_DEPTH, wanted=ends), cat).select("project", "version", "path", "snapshot_id", "depth")


@query("V08_deep_removals", f"WITH e AS ({_sql('>=').replace('max(version) AS version', 'max(version)-1 AS version')}) SELECT path AS unit_path FROM e WHERE project='chain5000' AND path NOT LIKE '%7'")
def _(spark, sf_dir):
    """Tombstones of an upload of every path ending in 7: all else that the parent of the longest chain's last version has."""
    cat, _ = _catalogue(spark, sf_dir)
    project = f"chain{LENGTHS[-1]}"
    last = cat.versions.where(F.col("project") == project).agg(F.max("version")).first()[0]
    uploaded = cat.descriptors.where("path like '%7'").select("path").distinct()
    return V.removals(cat, project, last, uploaded)
