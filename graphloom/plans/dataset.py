"""Queries of the core operators for training data: problems 2, 4 and 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy, incremental, skew
from ..session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.changed_files(table(spark, d, "scan_entry"), table(spark, d, "file_record"), table(spark, d, "index_run")).select("repo", "path")


def p2_backlog(spark: SparkSession, d: str) -> DataFrame:
    """New and changed files per repository."""
    todo = incremental.changed_files(table(spark, d, "scan_entry"), table(spark, d, "file_record"), table(spark, d, "index_run"))
    return todo.groupBy("repo", "state").agg(F.count(F.lit(1)).alias("files"), F.max("at").alias("newest_at"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.dominant_keys(table(spark, d, "code_edge").select("target", "kind"), ["target", "kind"]).select("target", "kind")


def p4_results(spark: SparkSession, d: str) -> DataFrame:
    """Per target and kind: rows, distinct sources, mean confidence, and the target's name, without hot tasks."""
    edges = table(spark, d, "code_edge").select("target", "kind", "source", F.get_json_object("metadata", "$.confidence").cast("double").alias("confidence"))
    newest = table(spark, d, "code_node").groupBy(F.col("id").alias("target")).agg(F.max(F.struct(F.coalesce("updated_at", F.lit(-1)).alias("at"), F.col("name"))).alias("s")).select("target", F.col("s.name").alias("target_name"))
    names = newest.unionByName(table(spark, d, "shared_symbol").select(F.col("id").alias("target"), F.col("name").alias("target_name")))
    plan = skew.SkewPlan(edges, ["target"])
    joined = skew.skew_join(edges, names, ["target"], "left", plan=plan)
    # Distinct sources: one row for each source first, so a hot key's sources are counted in many tasks.
    per_source = joined.groupBy("target", "kind", "source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("confidence") * 1000).cast("long")).alias("c"), F.count("confidence").alias("k"), F.max("target_name").alias("target_name"))
    out = per_source.groupBy("target", "kind").agg(F.sum("n").alias("n_rows"), F.count("source").alias("n_sources"), (F.sum("c") / F.sum("k") / 1000).alias("mean_confidence"), F.max("target_name").alias("target_name"))
    return out.withColumn("mean_confidence", F.round("mean_confidence", 6))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.code_links(table(spark, d, "code_edge").select("source", "target", "kind"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.cycle_nodes(_links(spark, d)).select("kind", "node_id")


def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    """Path, depth and root of every node that a root leads to."""
    return hierarchy.hierarchy(_links(spark, d)).select("kind", "node_id", "parent_id", "root_id", "depth", F.array_join("path", ">").alias("path"))


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All ancestor–descendant pairs, over every parent of a node and on cycles too."""
    return hierarchy.descendants(_links(spark, d))


def p6_unreached(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that no root leads to."""
    return hierarchy.unreached(_links(spark, d))


def queries() -> dict:
    own = (p2_found, p2_backlog, p4_found, p4_results, p6_found, p6_paths, p6_descendants, p6_unreached)
    return {f.__name__: f for f in own}


_P2 = """WITH runs AS (SELECT status, started_at, lead(started_at) OVER (ORDER BY started_at, run_no) AS next_at FROM index_run WHERE started_at IS NOT NULL),
dig AS (SELECT repo, path, indexed_at AS tm, lower(regexp_replace(trim(content_hash), '^[A-Za-z][A-Za-z0-9_-]*:\\s*', '')) AS digest FROM file_record),
rec AS (SELECT repo, path, arg_max(digest, tm) AS digest FROM dig f WHERE EXISTS (SELECT 1 FROM runs r WHERE r.status = 'ok' AND f.tm >= r.started_at AND (r.next_at IS NULL OR f.tm < r.next_at)) GROUP BY 1, 2),
seen AS (SELECT repo, path, max(seen_at) AS tm, arg_max(lower(regexp_replace(trim(content_hash), '^[A-Za-z][A-Za-z0-9_-]*:\\s*', '')), seen_at) AS digest FROM scan_entry GROUP BY 1, 2),
todo AS (SELECT s.repo, s.path, s.tm, CASE WHEN r.path IS NULL THEN 'new' ELSE 'changed' END AS state FROM seen s LEFT JOIN rec r ON s.repo IS NOT DISTINCT FROM r.repo AND s.path IS NOT DISTINCT FROM r.path WHERE r.path IS NULL OR r.digest IS DISTINCT FROM s.digest)"""
_P6 = """WITH RECURSIVE l AS (SELECT DISTINCT kind, CASE WHEN kind = 'extends' THEN target ELSE source END AS p, CASE WHEN kind = 'extends' THEN source ELSE target END AS c FROM code_edge WHERE kind IN ('contains', 'extends') AND source IS NOT NULL AND target IS NOT NULL),
root AS (SELECT DISTINCT kind, p AS node FROM l WHERE NOT EXISTS (SELECT 1 FROM l k WHERE k.kind = l.kind AND k.c = l.p))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _P2 + " SELECT repo, path FROM todo",
        "p2_backlog": _P2 + " SELECT repo, state, count(*) AS files, max(tm) AS newest_at FROM todo GROUP BY 1, 2",
        "p4_found": "SELECT target, kind FROM code_edge GROUP BY 1, 2 HAVING count(*) >= 0.01 * (SELECT count(*) FROM code_edge)",
        "p4_results": """WITH names AS (SELECT id, arg_max(name, coalesce(updated_at, -1)) AS name FROM code_node GROUP BY 1 UNION ALL SELECT id, name FROM shared_symbol)
SELECT target, kind, sum(n)::BIGINT AS n_rows, sum(s)::BIGINT AS n_sources, round(sum(c) / sum(k) / 1000, 6) AS mean_confidence, max(name) AS target_name FROM
(SELECT target, kind, count(*) AS n, count(DISTINCT source) AS s, sum(round(CAST(json_extract_string(metadata, '$.confidence') AS DOUBLE) * 1000)::BIGINT) AS c, count(json_extract_string(metadata, '$.confidence')) AS k FROM code_edge GROUP BY 1, 2) e LEFT JOIN names ON names.id = e.target GROUP BY 1, 2""",
        "p6_unreached": _P6 + """, r AS (SELECT kind, node FROM root UNION SELECT l.kind, l.c FROM r JOIN l ON l.kind = r.kind AND l.p = r.node)
SELECT kind, node AS node_id FROM (SELECT kind, p AS node FROM l UNION SELECT kind, c FROM l) a WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.kind = a.kind AND r.node = a.node)""",
        "p6_descendants": _P6 + """, r AS (SELECT kind, p AS a, c AS n, 1 AS d FROM l UNION SELECT r.kind, r.a, l.c, r.d + 1 FROM r JOIN l ON l.kind = r.kind AND l.p = r.n WHERE r.d < 60)
SELECT kind, a AS ancestor_id, n AS node_id, min(d) AS distance FROM r WHERE a <> n GROUP BY 1, 2, 3""",
        "p6_paths": _P6 + """, r AS (SELECT kind, node, 0 AS d FROM root UNION SELECT l.kind, l.c, r.d + 1 FROM r JOIN l ON l.kind = r.kind AND l.p = r.node WHERE r.d < 60),
dep AS (SELECT kind, node, min(d) AS depth FROM r GROUP BY 1, 2),
via AS (SELECT x.kind, l.c AS node, min(l.p) AS parent FROM dep x JOIN l ON l.kind = x.kind AND l.p = x.node JOIN dep y ON y.kind = l.kind AND y.node = l.c AND y.depth = x.depth + 1 GROUP BY 1, 2),
w AS (SELECT kind, node, NULL::VARCHAR AS parent, node AS root, 0 AS depth, node AS path FROM root UNION ALL SELECT v.kind, v.node, v.parent, w.root, w.depth + 1, w.path || '>' || v.node FROM w JOIN via v ON v.kind = w.kind AND v.parent = w.node)
SELECT kind, node AS node_id, parent AS parent_id, root AS root_id, depth, path FROM w""",
        "p6_found": """WITH RECURSIVE l AS (SELECT DISTINCT kind, source AS p, target AS c FROM code_edge WHERE kind IN ('contains', 'extends')),
r AS (SELECT kind, p AS start, c AS node FROM l UNION SELECT r.kind, r.start, l.c FROM r JOIN l ON l.kind = r.kind AND l.p = r.node)
SELECT DISTINCT kind, start AS node_id FROM r WHERE start = node""",
    }
