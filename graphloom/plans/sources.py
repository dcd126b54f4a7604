"""Queries of sources, extraction, frameworks, relevance and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import content_hash
from ..operators import relevance, store
from ..session import checkpoint, table
from ..sources import bindings, extract, frameworks, scan
from ..streaming import sync


def _texts(spark, d):
    """One text for each path."""
    docs = table(spark, d, "documents").filter("path IS NOT NULL AND text IS NOT NULL")
    top = docs.groupBy("path").agg(F.max(F.struct("collected_at", "doc_id", "text")).alias("s"))
    return top.select("path", F.col("s.text").alias("text"))


def s4_languages(spark, d):
    f = table(spark, d, "file_record").select("path").distinct()
    return f.select("path", scan.language_column(F.col("path")).alias("language"), scan.is_generated(F.col("path")).alias("generated"))


def s2_ignored(spark, d):
    f = table(spark, d, "file_record").select("path").distinct()
    return f.groupBy(scan.is_ignored(F.col("path")).alias("ignored")).agg(F.count(F.lit(1)).alias("files"))


def x1_nodes(spark, d):
    return extract.extract(_texts(spark, d)).nodes.select("id", "kind", "name", "qualified_name", "file_path", "start_line", "end_line")


def x1_references(spark, d):
    r = extract.extract(_texts(spark, d)).refs
    return r.groupBy("reference_kind", "language").agg(F.count(F.lit(1)).alias("refs"), F.countDistinct("reference_name").alias("names"))


def x16_sections(spark, d):
    docs = table(spark, d, "documents").filter("path IS NULL")
    return extract.markdown_sections(docs.select("doc_id", "text"))


def x2_file_nodes(spark, d):
    return _texts(spark, d).select(F.concat(F.lit("file:"), "path").alias("id"), F.size(F.split("text", "\n")).cast("long").alias("lines"), content_hash(F.col("text")).alias("content_hash"))


def fw_routes(spark, d):
    return frameworks.routes(_texts(spark, d))


def k9_corpus_terms(spark, d):
    return relevance.corpus_terms(store.load_graph(spark, d).nodes, ["journaling", "cacheinvalidation"])


def k19_relevant(spark, d):
    g = store.load_graph(spark, d)
    g = g._replace(nodes=checkpoint(g.nodes), edges=checkpoint(g.edges))
    return relevance.relevant(g, "how does foldArchive use the ledger cache")


def q6_code_slices(spark, d):
    n = store.load_graph(spark, d).nodes.filter("kind IN ('function', 'method') AND start_line IS NOT NULL").select("id", F.col("file_path").alias("path"), "start_line", "end_line")
    t = _texts(spark, d)
    return t.join(n, "path").select("id", F.octet_length(relevance.code_slice(F.col("text"), F.col("start_line"), F.col("end_line"), False)).alias("bytes"))


def r8_bindings(spark, d):
    """What imports bind, with the file of the module where it is known."""
    t = checkpoint(_texts(spark, d))
    b = bindings.import_bindings(t)
    found = bindings.resolve_bindings(b, t).select("file_path", "local", "source", "module_file")
    return b.join(found, ["file_path", "local", "source"], "left").select("file_path", "language", "local", "exported", "source", "module_file")


def r10i_receiver_types(spark, d):
    x = extract.extract(_texts(spark, d))
    return bindings.receiver_types(x.refs.filter("reference_kind = 'calls'"), x.nodes, _texts(spark, d))


def st_changes(spark, d):
    seen = table(spark, d, "scan_entry").groupBy("path").agg(F.max(F.struct("seen_at", "content_hash", "modified_at")).alias("s")).select("path", "s.content_hash", "s.modified_at")
    return sync.detect_changes(seen, table(spark, d, "file_record")).groupBy("change").agg(F.count(F.lit(1)).alias("files"))


def st_windows(spark, d):
    return sync.event_windows(table(spark, d, "events"))


def st_sessions(spark, d):
    return sync.debounce(table(spark, d, "events"), "30 minutes", key="user_id")


def st_rollup(spark, d):
    """Rows by every combination of language and kind."""
    return store.load_graph(spark, d).nodes.cube("language", "kind").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def queries() -> dict:
    own = (s4_languages, s2_ignored, x1_nodes, x1_references, x16_sections, x2_file_nodes, fw_routes, r8_bindings, r10i_receiver_types, k9_corpus_terms, k19_relevant, q6_code_slices, st_changes, st_windows, st_sessions, st_rollup)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from .graph import _G

    return {
        "s4_languages": """SELECT DISTINCT path, CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'rs' THEN 'rust' WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' END AS language,
regexp_matches(path, '(?:\\.pb\\.(?:go|js|ts|cc|h|swift|dart)|\\.pulsar\\.go|_mocks?\\.go|\\.(?:generated|gen)\\.[jt]sx?|_pb\\.[jt]s|\\.min\\.m?js|_pb2(?:_grpc)?\\.py|_pb2\\.pyi|\\.g\\.(?:cs|dart)|Grpc\\.(?:cs|java)|OuterClass\\.java|\\.(?:freezed|pbgrpc|chopper)\\.dart|\\.generated\\.rs)$|^mock_[^/]+\\.go$') AS generated FROM file_record""",
        "x2_file_nodes": "SELECT 'file:' || path AS id, len(string_split(text, chr(10))) AS lines, sha256(text) AS content_hash FROM (SELECT path, arg_max(text, struct_pack(a := collected_at, b := doc_id)) AS text FROM documents WHERE path IS NOT NULL AND text IS NOT NULL GROUP BY 1)",
        "st_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS began, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
        "st_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS began, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS events FROM s GROUP BY user_id, k""",
        "st_changes": """WITH s AS (SELECT path, max(struct_pack(a := seen_at, h := content_hash, m := modified_at)) AS s FROM scan_entry GROUP BY 1), f AS (SELECT path, arg_max(content_hash, indexed_at) AS h, max(indexed_at) AS i FROM file_record GROUP BY repo, path)
SELECT CASE WHEN s.path IS NULL THEN 'removed' WHEN f.path IS NULL THEN 'added' WHEN s.s.m <= f.i THEN 'unchanged' WHEN s.s.h = f.h THEN 'unchanged' ELSE 'changed' END AS change, count(*) AS files FROM s FULL JOIN f ON s.path = f.path GROUP BY 1""",
        "st_rollup": f"WITH {_G} SELECT language, kind, count(*) AS n, (grouping(language) * 2 + grouping(kind))::BIGINT AS level FROM node GROUP BY CUBE (language, kind)",
    }
