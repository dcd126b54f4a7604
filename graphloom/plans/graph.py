"""Queries of the graph operators over the code tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import module_of, node_id
from ..operators import analytics, resolve, search, store, synthesis, traverse
from ..schema import CALL_KINDS
from ..session import checkpoint, table
from ..sources import bindings

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


_G = """node AS (SELECT * EXCLUDE (rn) FROM (SELECT id, kind, name, qualified_name, file_path, language, start_line, end_line, docstring, signature, is_exported, route_method, route_path, framework,
row_number() OVER (PARTITION BY id ORDER BY coalesce(updated_at, -1) DESC, kind DESC NULLS LAST, name DESC NULLS LAST, qualified_name DESC NULLS LAST, file_path DESC NULLS LAST, language DESC NULLS LAST, start_line DESC NULLS LAST, end_line DESC NULLS LAST, start_column DESC NULLS LAST, end_column DESC NULLS LAST, docstring DESC NULLS LAST, signature DESC NULLS LAST) AS rn FROM code_node WHERE id IS NOT NULL) WHERE rn = 1
UNION ALL SELECT id, kind, name, qualified_name, file_path, language, start_line, end_line, NULL, NULL, NULL, NULL, NULL, NULL FROM shared_symbol),
edge AS (SELECT source, target, kind, coalesce(line, -1) AS line, coalesce(column_no, -1) AS col, min(provenance) AS provenance FROM code_edge WHERE source IN (SELECT id FROM node) AND target IN (SELECT id FROM node) GROUP BY 1, 2, 3, 4, 5)"""
_CALLS = "('" + "', '".join(CALL_KINDS) + "')"
_HUB = "SELECT target AS id FROM edge WHERE kind = 'calls' GROUP BY 1 ORDER BY count(*) DESC, target LIMIT 1"


def _graph(spark: SparkSession, d: str) -> store.Graph:
    return store.load_graph(spark, d)


def _hub(g: store.Graph) -> DataFrame:
    """The most called symbol (a top-1 report)."""
    return g.edges.filter("kind = 'calls'").groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(1).select("id")


def _seeds(g: store.Graph) -> DataFrame:
    """All functions and methods."""
    return g.nodes.filter(F.col("kind").isin("function", "method")).select("id")


_SEEDS = "SELECT id FROM node WHERE kind IN ('function', 'method')"


# -- identities and tables -------------------------------------------------------------------------------------------
@query("SELECT from_node_id, reference_name, kind, id FROM (SELECT from_node_id, reference_name, reference_kind AS kind, reference_kind || ':' || left(sha256(concat_ws(':', file_path, reference_kind, reference_name, line::VARCHAR)), 32) AS id FROM unresolved_ref)")
def i1_node_ids(spark, d):
    r = table(spark, d, "unresolved_ref")
    return r.select("from_node_id", "reference_name", F.col("reference_kind").alias("kind"), node_id(F.col("file_path"), F.col("reference_kind"), F.col("reference_name"), F.col("line")).alias("id"))


@query(f"WITH {_G} SELECT id, kind, name, file_path, start_line FROM node")
def n1_current_nodes(spark, d):
    return _graph(spark, d).nodes.select("id", "kind", "name", "file_path", "start_line")


@query(f"WITH {_G} SELECT n.id, n.name FROM node n WHERE n.id IN (SELECT from_node_id FROM unresolved_ref WHERE status = 'failed')")
def n2_get_nodes(spark, d):
    g = _graph(spark, d)
    return g.nodes.join(g.refs.filter("status = 'failed'").select(F.col("from_node_id").alias("id")).distinct(), "id", "left_semi").select("id", "name")


@query(f"WITH {_G} SELECT id, qualified_name FROM node WHERE lower(name) = 'api'")
def n3_nodes_by_name(spark, d):
    return store.nodes_by(_graph(spark, d).nodes, "name", "API", ignore_case=True).select("id", "qualified_name")


@query(f"WITH {_G} SELECT id, name FROM node WHERE starts_with(name, 'fold') ORDER BY id LIMIT 50")
def n4_name_prefix(spark, d):
    return store.nodes_with_prefix(_graph(spark, d).nodes, "fold", 50).select("id", "name")


@query(f"WITH {_G} SELECT name, count(*) AS nodes, count(DISTINCT file_path) AS files FROM node GROUP BY 1")
def n5_name_counts(spark, d):
    return store.name_counts(_graph(spark, d).nodes)


@query(f"WITH {_G} SELECT id, name FROM node WHERE kind = 'class' AND id > 'class:8' ORDER BY id LIMIT 100")
def n7_keyset_page(spark, d):
    return store.page_by_kind(_graph(spark, d).nodes, "class", "class:8", 100).select("id", "name")


@query(f"WITH {_G} SELECT DISTINCT name FROM node")
def s10_node_names(spark, d):
    return store.all_node_names(_graph(spark, d).nodes)


@query(f"WITH {_G} SELECT source, target, kind, line, col AS column_no FROM edge")
def e1_insert_edges(spark, d):
    return _graph(spark, d).edges.select("source", "target", "kind", F.coalesce("line", F.lit(-1)).alias("line"), F.coalesce("column_no", F.lit(-1)).alias("column_no"))


@query(f"WITH {_G}, hub AS ({_HUB}) SELECT e.source, e.target, e.kind, e.line, n.name AS neighbour_name FROM edge e JOIN node n ON n.id = e.source WHERE e.target IN (SELECT id FROM hub) AND e.kind = 'calls'")
def e2_incoming(spark, d):
    g = _graph(spark, d)
    hub = [r["id"] for r in _hub(g).collect()]  # one row
    return store.incoming(g, hub, ["calls"]).select("source", "target", "kind", F.coalesce("line", F.lit(-1)).alias("line"), "neighbour_name")


@query(f"WITH {_G}, s AS ({_SEEDS}) SELECT e.source, e.target, e.kind, e.line FROM edge e WHERE e.source IN (SELECT id FROM s)")
def e3_outgoing_batch(spark, d):
    g = _graph(spark, d)
    return g.edges.join(_seeds(g).withColumnRenamed("id", "source"), "source", "left_semi").select("source", "target", "kind", F.coalesce("line", F.lit(-1)).alias("line"))


@query(f"WITH {_G} SELECT source, target, kind, line FROM edge WHERE source IN (SELECT id FROM node WHERE kind = 'class') AND target IN (SELECT id FROM node WHERE kind = 'class')")
def e4_edges_between(spark, d):
    g = _graph(spark, d)
    return store.edges_between(g.edges, g.nodes.filter("kind = 'class'").select("id")).select("source", "target", "kind", F.coalesce("line", F.lit(-1)).alias("line"))


@query(f"WITH {_G} SELECT s.file_path AS source_file, t.file_path AS target_file, count(*) AS edges FROM edge e JOIN node s ON s.id = e.source JOIN node t ON t.id = e.target WHERE e.kind <> 'contains' AND s.file_path <> t.file_path GROUP BY 1, 2")
def e6_file_dependencies(spark, d):
    return store.file_dependencies(_graph(spark, d))


_FILES = "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY indexed_at DESC, content_hash DESC NULLS LAST, language DESC NULLS LAST, size DESC NULLS LAST, modified_at DESC NULLS LAST, node_count DESC NULLS LAST) AS rn FROM file_record) WHERE rn = 1)"


@query(f"WITH {_FILES} SELECT repo, path, content_hash, language, size, indexed_at FROM f")
def f1_current_files(spark, d):
    return store.current_files(table(spark, d, "file_record")).select("repo", "path", "content_hash", "language", "size", "indexed_at")


@query("SELECT from_node_id, reference_name, reference_kind, coalesce(line, -1) AS line FROM unresolved_ref WHERE status = 'pending' ORDER BY from_node_id, reference_name, reference_kind, coalesce(line, -1), coalesce(column_no, -1) LIMIT 200 OFFSET 100")
def u1_pending_page(spark, d):
    return store.pending_page(table(spark, d, "unresolved_ref"), 100, 200).select("from_node_id", "reference_name", "reference_kind", F.coalesce("line", F.lit(-1)).alias("line"))


@query("""WITH k AS (SELECT DISTINCT from_node_id, reference_name, reference_kind, name_tail FROM unresolved_ref WHERE status = 'failed'), a AS (SELECT DISTINCT name AS asked FROM shared_symbol),
h AS (SELECT from_node_id, reference_name, reference_kind, asked, row_number() OVER (PARTITION BY asked ORDER BY from_node_id, reference_name, reference_kind) AS n FROM k JOIN a ON a.asked = k.reference_name OR a.asked = k.name_tail)
SELECT DISTINCT from_node_id, reference_name, reference_kind FROM h WHERE n <= 5""")
def u3_retryable_failed(spark, d):
    return store.retryable_failed(table(spark, d, "unresolved_ref"), table(spark, d, "shared_symbol").select("name"), 5)


@query(f"WITH {_G}, {_FILES} SELECT 'total' AS what, 'nodes' AS key, count(*) AS n FROM node UNION ALL SELECT 'total', 'edges', count(*) FROM edge UNION ALL SELECT 'total', 'files', count(*) FROM f UNION ALL SELECT 'node_kind', kind, count(*) FROM node GROUP BY kind UNION ALL SELECT 'edge_kind', kind, count(*) FROM edge GROUP BY kind UNION ALL SELECT 'language', language, count(*) FROM f GROUP BY language")
def m2_stats(spark, d):
    return store.stats(_graph(spark, d))


@query(f"WITH {_G} SELECT n.file_path, count(*) AS edges FROM edge e JOIN node n ON n.id = e.source GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2")
def m4_dominant_files(spark, d):
    return store.dominant_files(_graph(spark, d))


@query(f"WITH {_G} SELECT kind, count(*) AS n, max(start_line) AS last_line FROM node GROUP BY kind")
def m6_raw_select(spark, d):
    return store.raw_select(spark, _graph(spark, d), "SELECT n.kind, count(*) AS n, max(n.start_line) AS last_line FROM node n WHERE replace(n.kind, 'x', 'y') IS NOT NULL GROUP BY n.kind")


# -- traversals ------------------------------------------------------------------------------------------------------
def _bfs_sql(starts: str, edges: str, depth: int) -> str:
    return f"""WITH RECURSIVE {_G}, s AS ({starts}), e AS (SELECT DISTINCT here, there FROM ({edges}) WHERE here <> there),
w AS (SELECT id AS start_id, id, 0 AS depth FROM s UNION SELECT w.start_id, e.there, w.depth + 1 FROM w JOIN e ON e.here = w.id WHERE w.depth < {depth})
SELECT start_id, id, min(depth) AS depth FROM w GROUP BY 1, 2 HAVING min(depth) > 0"""


@query(_bfs_sql(_HUB, f"SELECT target AS here, source AS there FROM edge WHERE kind IN {_CALLS}", 2))
def t1_callers_bfs(spark, d):
    g = _graph(spark, d)
    return traverse.callers(g, _hub(g), 2)


@query(_bfs_sql(_SEEDS, f"SELECT source AS here, target AS there FROM edge WHERE kind IN {_CALLS}", 3))
def t1_callees_bfs(spark, d):
    g = _graph(spark, d)
    return traverse.callees(g, _seeds(g), 3)


@query()
def t1_callers_exact(spark, d):
    g = _graph(spark, d)
    hub = _hub(g).first()["id"]
    return traverse.exact_walk(g, hub, 2, "in").select("id", "depth", "ord")


@query(f"""WITH RECURSIVE {_G}, hub AS (SELECT target AS id FROM edge WHERE kind = 'extends' GROUP BY 1 ORDER BY count(*) DESC, target LIMIT 1),
cont AS (SELECT DISTINCT e.source AS here, e.target AS there FROM edge e JOIN node n ON n.id = e.source WHERE e.kind = 'contains' AND n.kind IN ('class', 'interface', 'struct', 'trait', 'protocol', 'module', 'enum')),
back AS (SELECT DISTINCT target AS here, source AS there FROM edge WHERE kind <> 'contains'),
x AS (SELECT here, there, 0 AS c FROM cont UNION ALL SELECT here, there, 1 FROM back),
w AS (SELECT id, 0 AS depth FROM hub UNION SELECT x.there, w.depth + x.c FROM w JOIN x ON x.here = w.id WHERE w.depth + x.c <= 2)
SELECT id, min(depth) AS depth FROM w GROUP BY 1""")
def t2_impact(spark, d):
    g = _graph(spark, d)
    hub = g.edges.filter("kind = 'extends'").groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(1).select("id")
    return traverse.impact(g, hub, 2).select("id", "depth")


@query()
def t3_find_path(spark, d):
    """The way from the first seed to the hub."""
    g = _graph(spark, d)
    g = g._replace(edges=checkpoint(g.edges), nodes=checkpoint(g.nodes))
    hub = _hub(g).first()["id"]
    far = traverse.callers(g, g.nodes.filter(F.col("id") == hub).select("id"), 3)
    start = far.filter("depth = 3").agg(F.min("id")).first()[0] or far.agg(F.min("id")).first()[0]
    return traverse.find_path(g, start, hub, CALL_KINDS)


@query(f"""WITH RECURSIVE {_G}, s AS (SELECT id FROM node WHERE kind = 'class'), e AS (SELECT DISTINCT source, target FROM edge WHERE kind IN ('extends', 'implements') AND source <> target),
up AS (SELECT id AS start_id, id, 0 AS depth FROM s UNION SELECT up.start_id, e.target, up.depth + 1 FROM up JOIN e ON e.source = up.id WHERE up.depth < 32),
dn AS (SELECT id AS start_id, id, 0 AS depth FROM s UNION SELECT dn.start_id, e.source, dn.depth + 1 FROM dn JOIN e ON e.target = dn.id WHERE dn.depth < 32),
a AS (SELECT start_id, id, 'ancestor' AS relation, min(depth) AS depth FROM up WHERE id <> start_id GROUP BY 1, 2), b AS (SELECT start_id, id, 'descendant' AS relation, min(depth) AS depth FROM dn WHERE id <> start_id GROUP BY 1, 2)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.start_id = b.start_id AND a.id = b.id)""")
def t4_type_hierarchy(spark, d):
    g = _graph(spark, d)
    return traverse.type_hierarchy(g, g.nodes.filter(F.col("kind") == "class").select("id"))


@query()
def t5_traverse(spark, d):
    g = _graph(spark, d)
    hub = _hub(g).first()["id"]
    return traverse.traverse(g, hub, 2, "both", limit=300)[0].select("id", "depth", "ord")


@query(_bfs_sql(_SEEDS, "SELECT target AS here, source AS there FROM (SELECT target, source, row_number() OVER (PARTITION BY target ORDER BY line, source) AS n FROM edge WHERE kind = 'contains') WHERE n = 1", 64))
def t6_ancestors(spark, d):
    g = _graph(spark, d)
    return traverse.ancestors(g, _seeds(g))


@query(f"""WITH RECURSIVE {_G}, dep AS (SELECT DISTINCT t.file_path AS here, s.file_path AS there FROM edge e JOIN node s ON s.id = e.source JOIN node t ON t.id = e.target WHERE e.kind <> 'contains' AND s.file_path <> t.file_path),
f AS (SELECT file_path AS path FROM node WHERE kind = 'function' ORDER BY id LIMIT 1), w AS (SELECT path, 0 AS depth FROM f UNION SELECT dep.there, w.depth + 1 FROM w JOIN dep ON dep.here = w.path WHERE w.depth < 3)
SELECT path, min(depth) AS depth FROM w GROUP BY 1""")
def t8_affected(spark, d):
    g = _graph(spark, d)
    first = g.nodes.filter("kind = 'function'").orderBy("id").limit(1).first()["file_path"]
    return traverse.affected_files(g, [first], 3)


@query()
def t9_flows(spark, d):
    g = _graph(spark, d)
    seeds = [r["source"] for r in g.edges.filter("kind = 'calls'").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(4).collect()]
    return traverse.flows(g, seeds, ["cache", "ledger"], 4, 500).select(F.array_join("path", ">").alias("path"), "hops", "concepts")


@query(f"WITH {_G} SELECT source AS id, 'dynamic' AS boundary, count(*) AS n FROM edge WHERE provenance = 'heuristic' GROUP BY 1 UNION ALL SELECT target, 'polymorphic', count(DISTINCT source) FROM edge WHERE kind IN ('overrides', 'implements') GROUP BY 1 HAVING count(DISTINCT source) >= 2")
def t10_boundaries(spark, d):
    return traverse.boundaries(_graph(spark, d))


# -- search ----------------------------------------------------------------------------------------------------------
_WORDS = "list_transform(regexp_extract_all(coalesce({0}, ''), '([A-Z]+(?:[^a-zA-Z]|$)|[A-Z]?[a-z]+|[0-9]+|[A-Z]+)'), lambda x: x)"


@query()
def k1_postings(spark, d):
    p = search.postings(_graph(spark, d).nodes)
    return p.groupBy("field").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("term").alias("terms"), F.sum("tf").alias("words"))


@query()
def k2_search_fts(spark, d):
    return search.search_fts(_graph(spark, d).nodes, "fold cache", 50, match_all=False).withColumn("score", F.round("score", 6))


@query(f"""WITH {_G} SELECT id, name, CASE WHEN name = 'cache' THEN 1.0 WHEN lower(name) = 'cache' THEN 0.9 WHEN starts_with(lower(name), 'cache') THEN 0.8 WHEN contains(lower(name), 'cache') THEN 0.7 ELSE 0.5 END::DOUBLE AS score
FROM node WHERE contains(lower(name), 'cache') OR contains(lower(qualified_name), 'cache') ORDER BY score DESC, strlen(name), name, id LIMIT 100""")
def k3_name_like(spark, d):
    return search.search_name_like(_graph(spark, d).nodes, "cache", 100)


@query(f"WITH {_G}, h AS (SELECT lower(name) AS asked, id, name, row_number() OVER (PARTITION BY lower(name) ORDER BY id) AS n FROM node WHERE lower(name) IN ('api', 'store', 'constructor')) SELECT asked, id, name FROM h WHERE n <= 20")
def k4_exact_names(spark, d):
    return search.find_by_exact_names(_graph(spark, d).nodes, ["api", "Store", "constructor"], 20)


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT q.query_id, e.vec_id AS id, list_cosine_similarity(q.v, e.embedding::DOUBLE[]) AS s FROM q JOIN embeddings e ON e.vec_id <> q.query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS rank FROM p) SELECT query_id, id, round(s, 6) AS similarity, rank FROM r WHERE rank <= 10""")
def k5_vector_search(spark, d):
    return search.vector_neighbours(table(spark, d, "embeddings"))


@query()
def k6_hybrid(spark, d):
    n = _graph(spark, d).nodes
    n = checkpoint(n)
    return search.reciprocal_rank_fusion(search.ranked(search.search_fts(n, "fold cache", 50, match_all=False)), search.ranked(search.search_name_like(n, "cache", 50))).limit(50)


# -- analytics -------------------------------------------------------------------------------------------------------
@query(f"WITH {_G} SELECT CASE WHEN contains(file_path, '/') THEN split_part(file_path, '/', 1) ELSE '(root)' END AS module, count(*) AS nodes, count(DISTINCT file_path) AS files FROM node GROUP BY 1")
def a2_modules(spark, d):
    return analytics.module_counts(_graph(spark, d).nodes, 1)


@query(f"WITH {_G}, x AS (SELECT source AS id, 1 AS o, 0 AS i FROM edge UNION ALL SELECT target, 0, 1 FROM edge), g AS (SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, count(*) AS degree FROM x GROUP BY 1) SELECT g.id, in_degree, out_degree, degree, name, kind FROM g JOIN node USING (id) ORDER BY degree DESC, name, id LIMIT 10")
def a3_god_nodes(spark, d):
    return analytics.god_nodes(_graph(spark, d))


@query()
def a4_communities(spark, d):
    g = _graph(spark, d)
    c = analytics.communities(g.edges.filter("kind IN ('calls', 'references', 'instantiates')"))
    return c.groupBy("community").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("first_member"))


@query(f"""WITH RECURSIVE {_G}, m AS (SELECT id, split_part(file_path, '/', 1) || '/' || split_part(file_path, '/', 2) AS m FROM node WHERE len(string_split(file_path, '/')) > 2), e AS (SELECT DISTINCT a.m AS a, b.m AS b FROM edge JOIN m a ON a.id = source JOIN m b ON b.id = target WHERE kind = 'imports' AND coalesce(provenance, '') <> 'heuristic' AND a.m <> b.m),
r AS (SELECT a AS s, b AS n FROM e UNION SELECT r.s, e.b FROM r JOIN e ON e.a = r.n) SELECT min(y.n) AS component, x.s AS id FROM r x JOIN r y ON y.s = x.s JOIN r z ON z.s = y.n AND z.n = x.s WHERE x.s = x.n GROUP BY x.s""")
def a5_import_cycles(spark, d):
    g = _graph(spark, d)
    n = g.nodes.filter(F.size(F.split("file_path", "/")) > 2)
    return analytics.import_cycles(g._replace(nodes=n), 2)


@query()
def a6_betweenness(spark, d):
    g = _graph(spark, d)
    e = g.edges.filter("kind IN ('extends', 'implements', 'imports')")
    return analytics.betweenness(e).filter("betweenness > 0")


@query(f"WITH {_G}, m AS (SELECT id, CASE WHEN contains(file_path, '/') THEN split_part(file_path, '/', 1) ELSE '(root)' END AS m FROM node) SELECT a.m AS source_module, b.m AS target_module, count(*) AS edges FROM edge JOIN m a ON a.id = source JOIN m b ON b.id = target WHERE kind <> 'contains' GROUP BY 1, 2")
def a8_module_matrix(spark, d):
    return analytics.module_matrix(_graph(spark, d), 1)


@query()
def a8_insights(spark, d):
    g = _graph(spark, d)
    return analytics.insights(g._replace(nodes=checkpoint(g.nodes), edges=checkpoint(g.edges)))


@query(f"""WITH {_G}, late AS (SELECT quantile_disc(updated_at, 0.5) AS t FROM code_node), n AS (SELECT id AS key, NOT id IN (SELECT id FROM code_node WHERE updated_at <= (SELECT t FROM late)) AS new FROM node WHERE id IN (SELECT id FROM code_node))
SELECT 'node' AS what, 'added' AS change, key FROM n WHERE new""")
def a11_graph_diff(spark, d):
    """What came after the median update."""
    nodes, shared = table(spark, d, "code_node"), table(spark, d, "shared_symbol").select("id")
    t = nodes.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY updated_at)")).first()[0]
    g = _graph(spark, d)
    g = g._replace(nodes=g.nodes.join(shared, "id", "left_anti"))
    before = g._replace(nodes=store.current_nodes(nodes.filter(F.col("updated_at") <= t)), edges=g.edges)
    return analytics.graph_diff(before, g)


@query()
def a12_export_jsonl(spark, d):
    return analytics.export_lines(_graph(spark, d), "jsonl")


@query()
def a12_export_graphml(spark, d):
    return analytics.export_lines(_graph(spark, d), "graphml")


@query()
def a12_export_dot(spark, d):
    return analytics.export_lines(_graph(spark, d), "dot")


# -- resolution ------------------------------------------------------------------------------------------------------
def _resolved(spark, d):
    g = _graph(spark, d)
    g = g._replace(nodes=checkpoint(g.nodes), edges=checkpoint(g.edges))
    texts = table(spark, d, "documents").filter("path IS NOT NULL AND text IS NOT NULL").select("path", "text")
    imports = bindings.resolve_bindings(bindings.import_bindings(texts).distinct(), texts.select("path"))
    first = checkpoint(resolve.resolve(g, imports=imports))
    # The second round: members of supertypes, for what is still open.
    rest = resolve.with_ref_id(g.refs).join(first.select("ref_id"), "ref_id", "left_anti")
    return g, first.unionByName(resolve.inherited_members(g, rest).select(*first.columns))


@query()
def r13_resolved(spark, d):
    return _resolved(spark, d)[1].select("from_node_id", "reference_name", "reference_kind", F.coalesce("line", F.lit(-1)).alias("line"), "target", "confidence", "resolved_by")


@query()
def r14_edges(spark, d):
    g, r = _resolved(spark, d)
    return resolve.to_edges(r, g.nodes).select("source", "target", "kind", F.coalesce("line", F.lit(-1)).alias("line"), "metadata")


@query()
def r15_stats(spark, d):
    return resolve.resolution_stats(_resolved(spark, d)[1])


@query(f"""WITH {_G}, r AS (SELECT DISTINCT from_node_id, reference_name, reference_kind, line, column_no, file_path, language FROM unresolved_ref WHERE reference_kind NOT LIKE 'doc_%' AND reference_kind <> 'function_ref'),
s AS (SELECT id, lower(name) AS low, language FROM node WHERE kind IN ('function', 'method', 'class')),
fam AS (SELECT unnest(['java', 'kotlin', 'scala', 'swift', 'objc', 'typescript', 'tsx', 'javascript', 'jsx', 'arkts', 'c', 'cpp', 'csharp', 'razor']) AS l, unnest(['jvm', 'jvm', 'jvm', 'apple', 'apple', 'web', 'web', 'web', 'web', 'web', 'c', 'c', 'dotnet', 'dotnet']) AS f),
h AS (SELECT r.*, s.id AS target, coalesce(r.language = s.language, false) AS same FROM r JOIN s ON s.low = lower(list_last(regexp_split_to_array(r.reference_name, '\\.|::'))) AND s.id <> r.from_node_id LEFT JOIN fam a ON a.l = r.language LEFT JOIN fam b ON b.l = s.language
WHERE CASE WHEN r.reference_kind = 'references' THEN coalesce(r.language = s.language OR a.f = b.f, false) WHEN r.reference_kind = 'imports' THEN NOT coalesce(a.f IS NOT NULL AND b.f IS NOT NULL AND a.f <> b.f, false) ELSE true END),
g AS (SELECT *, max(same) OVER (PARTITION BY from_node_id, reference_name, reference_kind, line, column_no, file_path, language) AS any_same FROM h),
k AS (SELECT *, count(*) OVER (PARTITION BY from_node_id, reference_name, reference_kind, line, column_no, file_path, language) AS n FROM g WHERE NOT any_same OR same)
SELECT from_node_id, reference_name, reference_kind, coalesce(line, -1) AS line, target, CASE WHEN same THEN 0.5 ELSE 0.3 END::DOUBLE AS confidence FROM k WHERE n = 1""")
def r10d_fuzzy(spark, d):
    g = _graph(spark, d)
    refs = checkpoint(resolve.with_ref_id(g.refs).filter(~F.col("reference_kind").startswith("doc_") & (F.col("reference_kind") != "function_ref")))
    return refs.join(resolve.by_fuzzy_name(refs, resolve.symbols(g.nodes)), "ref_id").select("from_node_id", "reference_name", "reference_kind", F.coalesce("line", F.lit(-1)).alias("line"), "target", "confidence")


@query(f"""WITH {_G}, p AS (SELECT DISTINCT file_path, line FROM unresolved_ref WHERE line IS NOT NULL AND file_path IS NOT NULL),
h AS (SELECT p.file_path, p.line, n.id, row_number() OVER (PARTITION BY p.file_path, p.line ORDER BY n.end_line - n.start_line, -n.start_line, n.id) AS r FROM p JOIN node n ON n.file_path = p.file_path AND p.line BETWEEN n.start_line AND n.end_line WHERE n.kind IN ('function', 'method', 'component'))
SELECT file_path, line, id AS enclosing_id FROM h WHERE r = 1""")
def y5_enclosing(spark, d):
    g = _graph(spark, d)
    return synthesis.enclosing_function(g.refs.filter("line IS NOT NULL AND file_path IS NOT NULL").select("file_path", "line").distinct(), g.nodes)


@query()
def y_synthesized(spark, d):
    g = _graph(spark, d)
    docs = table(spark, d, "documents").filter("path IS NOT NULL")
    lang = F.when(F.col("path").endswith(".js"), "javascript").when(F.col("path").endswith(".ts"), "typescript")
    texts = docs.select(F.col("path").alias("file_path"), lang.alias("language"), "text")
    return synthesis.synthesize(g._replace(nodes=checkpoint(g.nodes), edges=checkpoint(g.edges)), texts).select("source", "target", "kind", "metadata")


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
