"""The graph as tables: reading it clean, point and batch reads, writes with their rules, maintenance.

Writes are functions from tables to tables; ``save`` writes a new snapshot and then a numbered manifest, of which the newest
counts, so readers never see half a write. Order where the store had insertion order is made explicit.
"""

from __future__ import annotations

import json
import re
import threading
import uuid
from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import name_tail
from ..schema import EDGE, FILE, NODE, REF
from ..session import table


class Graph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame
    refs: DataFrame
    files: DataFrame


_ORDER = ("kind", "name", "qualified_name", "file_path", "language", "start_line", "end_line", "start_column", "end_column", "docstring", "signature")


def current_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each id, the one of the latest ``updated_at``."""
    rest = [c for c in nodes.columns if c not in ("id", "updated_at", *_ORDER)]
    own = F.struct(F.coalesce("updated_at", F.lit(-1)).alias("_at"), *_ORDER, *rest, "updated_at")
    top = nodes.filter(F.col("id").isNotNull()).groupBy("id").agg(F.max(own).alias("_s"))
    return top.select(*[F.col("id") if c == "id" else F.col(f"_s.{c}").alias(c) for c in nodes.columns])


def edge_key(line: str = "line", column: str = "column_no") -> list[Column]:
    return [F.col("source"), F.col("target"), F.col("kind"), F.coalesce(line, F.lit(-1)), F.coalesce(column, F.lit(-1))]


def unique_edges(edges: DataFrame) -> DataFrame:
    """One row for each identity (source, target, kind, line, column; no position is a position): as tables have no first
    row, the least by provenance and metadata, whole."""
    keys = edges.withColumns({"_l": F.coalesce("line", F.lit(-1)), "_c": F.coalesce("column_no", F.lit(-1))})
    one = keys.groupBy("source", "target", "kind", "_l", "_c").agg(F.min(F.struct("provenance", "metadata")).alias("s")).select("*", "s.*")
    return one.select("source", "target", "kind", "metadata", F.when(F.col("_l") >= 0, F.col("_l")).alias("line"), F.when(F.col("_c") >= 0, F.col("_c")).alias("column_no"), "provenance")


def insert_edges(edges: DataFrame, nodes: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Edges to add: unknown ends dropped first, then one for each identity, none that exists."""
    ids = nodes.select("id")
    known = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    one = unique_edges(known.select(*EDGE.names))
    if existing is None:
        return one
    a, b = one.alias("a"), existing.alias("b")
    same = (F.col("a.source") == F.col("b.source")) & (F.col("a.target") == F.col("b.target")) & (F.col("a.kind") == F.col("b.kind"))
    for c in ("line", "column_no"):
        same = same & (F.coalesce(f"a.{c}", F.lit(-1)) == F.coalesce(f"b.{c}", F.lit(-1)))
    return a.join(b, same, "left_anti")


def load_graph(spark: SparkSession, d: str) -> Graph:
    """The graph of the code tables: current nodes and shared symbols, unique edges between known nodes."""
    shared = table(spark, d, "shared_symbol")
    missing = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in NODE if f.name not in shared.columns}
    nodes = current_nodes(table(spark, d, "code_node")).unionByName(shared.withColumns(missing).select(*NODE.names))
    edges = insert_edges(table(spark, d, "code_edge"), nodes)
    return Graph(nodes, edges, table(spark, d, "unresolved_ref"), table(spark, d, "file_record"))


# -- nodes -----------------------------------------------------------------------------------------------------------
def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def get_nodes(nodes: DataFrame, ids: Iterable[str]) -> DataFrame:
    return nodes.filter(F.col("id").isin(*ids))


def nodes_by(nodes: DataFrame, column: str, value: str, ignore_case: bool = False) -> DataFrame:
    """Nodes by file_path, kind, name or qualified_name."""
    return nodes.filter(F.lower(column) == value.lower() if ignore_case else F.col(column) == value)


def nodes_with_prefix(nodes: DataFrame, prefix: str, limit: int) -> DataFrame:
    return nodes.filter(F.col("name").startswith(prefix)).orderBy("id").limit(limit)


def name_counts(nodes: DataFrame) -> DataFrame:
    """``name, nodes, files``."""
    return nodes.groupBy("name").agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("file_path").alias("files"))


def find_route(nodes: DataFrame, path: str, framework: str | None = None, method: str | None = None) -> DataFrame:
    hit = nodes.filter((F.col("kind") == "route") & (F.col("route_path") == path))
    if framework:
        hit = hit.filter(F.col("framework") == framework)
    if method:
        hit = hit.filter(F.col("route_method") == method)
    return hit.orderBy("file_path", "start_line", "name")


def page_by_kind(nodes: DataFrame, kind: str, after: str, limit: int) -> DataFrame:
    return nodes.filter((F.col("kind") == kind) & (F.col("id") > after)).orderBy("id").limit(limit)


def all_node_names(nodes: DataFrame) -> DataFrame:
    return nodes.select("name").distinct().orderBy("name")


# -- edges -----------------------------------------------------------------------------------------------------------
def outgoing(graph: Graph, ids: Iterable[str], kinds: Iterable[str] = (), provenance: str | None = None) -> DataFrame:
    """Edges that leave the nodes, with the neighbour's name and kind; edges to unknown nodes do not count."""
    return _around(graph, ids, kinds, "source", "target", provenance)


def incoming(graph: Graph, ids: Iterable[str], kinds: Iterable[str] = ()) -> DataFrame:
    return _around(graph, ids, kinds, "target", "source", None)


def _around(graph: Graph, ids, kinds, here: str, there: str, provenance: str | None) -> DataFrame:
    e = graph.edges.filter(F.col(here).isin(*ids))
    if kinds:
        e = e.filter(F.col("kind").isin(*kinds))
    if provenance:
        e = e.filter(F.col("provenance") == provenance)
    n = graph.nodes.select(F.col("id").alias(there), F.col("name").alias("neighbour_name"), F.col("kind").alias("neighbour_kind"))
    return e.join(n, there).select(F.col(here).alias("queried_id"), "source", "target", "kind", "line", "column_no", "provenance", "neighbour_name", "neighbour_kind")


def edges_between(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids`` (column ``id``)."""
    return edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi")


def _with_files(graph: Graph) -> DataFrame:
    n = graph.nodes
    s = n.select(F.col("id").alias("source"), F.col("file_path").alias("source_file"))
    t = n.select(F.col("id").alias("target"), F.col("file_path").alias("target_file"), F.col("name").alias("target_name"), F.col("kind").alias("target_kind"))
    return graph.edges.filter(F.col("kind") != "contains").join(s, "source").join(t, "target")


def cross_file_incoming(graph: Graph, path: str) -> DataFrame:
    """Edges into a file from others, with the name and kind of their target."""
    return _with_files(graph).filter((F.col("target_file") == path) & (F.col("source_file") != path)).select("source", "target", "kind", "line", "source_file", "target_name", "target_kind")


def file_dependencies(graph: Graph) -> DataFrame:
    """``source_file, target_file, edges``: all dependencies between files."""
    e = _with_files(graph).filter(F.col("source_file") != F.col("target_file"))
    return e.groupBy("source_file", "target_file").agg(F.count(F.lit(1)).alias("edges"))


def dependent_files(graph: Graph, path: str) -> DataFrame:
    return file_dependencies(graph).filter(F.col("target_file") == path).select(F.col("source_file").alias("path")).distinct().orderBy("path")


def dependency_files(graph: Graph, path: str) -> DataFrame:
    return file_dependencies(graph).filter(F.col("source_file") == path).select(F.col("target_file").alias("path")).distinct().orderBy("path")


# -- files -----------------------------------------------------------------------------------------------------------
def current_files(files: DataFrame) -> DataFrame:
    """The record of the largest ``indexed_at`` for each file."""
    rest = [c for c in files.columns if c not in ("repo", "path", "indexed_at")]
    top = files.groupBy("repo", "path").agg(F.max(F.struct("indexed_at", *rest)).alias("_s"))
    return top.select(*[c if c in ("repo", "path") else F.col(f"_s.{c}").alias(c) for c in files.columns])


def delete_file(graph: Graph, path: str) -> Graph:
    """Everything of a file goes: its refs, its nodes, edges that touch them, its record."""
    gone = graph.nodes.filter(F.col("file_path") == path).select("id")
    edges = graph.edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti").select(*graph.edges.columns)
    refs = graph.refs.filter(~F.col("file_path").eqNullSafe(F.lit(path))).join(gone.withColumnRenamed("id", "from_node_id"), "from_node_id", "left_anti").select(*graph.refs.columns)
    return Graph(graph.nodes.filter(~F.col("file_path").eqNullSafe(F.lit(path))), edges, refs, graph.files.filter(F.col("path") != path))


class Replaced(NamedTuple):
    graph: Graph
    counts: dict[str, DataFrame]


def replace_file(graph: Graph, path: str, nodes: DataFrame, edges: DataFrame, refs: DataFrame, record: DataFrame) -> Replaced:
    """A file's new extraction in place of the old.

    Edges into the file from others are kept if a new node has the name and kind of their target (the earliest by start
    line and id), become references again if they carry the name and kind they were resolved from, else are dropped.
    """
    snapshot = cross_file_incoming(graph, path)
    meta = graph.edges.select("source", "target", "kind", F.coalesce("line", F.lit(-1)).alias("_l"), "metadata", "column_no", "provenance")
    base = delete_file(graph, path)
    new = nodes.filter("id != '' AND name != '' AND file_path != ''")
    old_ids = graph.nodes.filter(F.col("file_path") == path)
    came = snapshot.withColumn("_l", F.coalesce("line", F.lit(-1))).join(meta, ["source", "target", "kind", "_l"])
    first = new.groupBy("name", "kind").agg(F.min(F.struct("start_line", "id")).alias("_s")).select(F.col("name").alias("target_name"), F.col("kind").alias("target_kind"), F.col("_s.id").alias("new_target"))
    came = came.join(first, ["target_name", "target_kind"], "left")
    attached = came.filter("new_target IS NOT NULL").select("source", F.col("new_target").alias("target"), "kind", "metadata", "line", "column_no", "provenance")
    name, kind = F.get_json_object("metadata", "$.refName"), F.get_json_object("metadata", "$.refKind")
    again = came.filter("new_target IS NULL").filter(name.isNotNull() & kind.isNotNull())
    source = graph.nodes.select(F.col("id").alias("source"), "file_path", "language")
    raised = again.join(source, "source").select(
        F.col("source").alias("from_node_id"), name.alias("reference_name"), kind.alias("reference_kind"), "line", "column_no", F.array().cast("array<string>").alias("candidates"), "file_path", "language", F.lit("pending").alias("status"), name_tail(name).alias("name_tail")
    )
    all_nodes = upsert(base.nodes, new, ["id"])
    added = insert_edges(edges.select(*EDGE.names).unionByName(attached), all_nodes, base.edges)
    out = Graph(all_nodes, base.edges.select(*EDGE.names).unionByName(added.select(*EDGE.names)), base.refs.select(*REF.names).unionByName(refs.select(*REF.names)).unionByName(raised), base.files.unionByName(record.select(*base.files.columns)))
    one = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    return Replaced(out, {"nodes": one(new), "edges": one(edges), "reattached": one(attached), "resurrected": one(raised), "removed_nodes": one(old_ids)})


# -- references ------------------------------------------------------------------------------------------------------
REF_KEY = ("from_node_id", "reference_name", "reference_kind")


def pending_page(refs: DataFrame, offset: int, limit: int) -> DataFrame:
    order = [*REF_KEY, F.coalesce("line", F.lit(-1)), F.coalesce("column_no", F.lit(-1))]
    return refs.filter(F.col("status") == "pending").orderBy(*order).offset(offset).limit(limit)


def refs_by_files(refs: DataFrame, paths: Iterable[str]) -> DataFrame:
    return refs.filter(F.col("file_path").isin(*paths))


def mark_failed(refs: DataFrame, keys: DataFrame) -> DataFrame:
    hit = keys.select(*REF_KEY).distinct().withColumn("_hit", F.lit(True))
    out = refs.join(hit, list(REF_KEY), "left")
    return out.withColumn("status", F.when(F.col("_hit"), "failed").otherwise(F.col("status"))).select(*refs.columns)


def delete_resolved(refs: DataFrame, keys: DataFrame) -> DataFrame:
    return refs.join(keys.select(*REF_KEY).distinct(), list(REF_KEY), "left_anti").select(*refs.columns)


def replace_pending_with_failed(refs: DataFrame, failed: DataFrame) -> DataFrame:
    return refs.filter(F.col("status") != "pending").unionByName(failed.withColumn("status", F.lit("failed")).select(*refs.columns))


def retryable_failed(refs: DataFrame, names: DataFrame, ceiling: int) -> DataFrame:
    """Failed references whose name or tail is among ``names``; at most ``ceiling`` keys for each name asked for."""
    keys = refs.filter(F.col("status") == "failed").select(*REF_KEY, "name_tail").distinct()
    asked = names.select(F.col("name").alias("asked")).distinct()
    hit = keys.withColumn("asked", F.explode(F.array_distinct(F.array_compact(F.array("reference_name", "name_tail"))))).join(asked, "asked")
    n = F.row_number().over(W.partitionBy("asked").orderBy(*REF_KEY))
    return hit.withColumn("_n", n).filter(F.col("_n") <= ceiling).select(*REF_KEY).distinct()


# -- maintenance -----------------------------------------------------------------------------------------------------
def stats(graph: Graph) -> DataFrame:
    """``what, key, n``: totals, nodes and edges by kind, files by language."""
    total = lambda df, key: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("what"), F.lit(key).alias("key"), "n")
    by = lambda df, c, what: df.groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "key", "n")
    files = current_files(graph.files)
    out = total(graph.nodes, "nodes").unionByName(total(graph.edges, "edges")).unionByName(total(files, "files"))
    return out.unionByName(by(graph.nodes, "kind", "node_kind")).unionByName(by(graph.edges, "kind", "edge_kind")).unionByName(by(files, "language", "language"))


def dominant_files(graph: Graph, top: int = 2) -> DataFrame:
    """The files that most edges leave."""
    f = graph.nodes.select(F.col("id").alias("source"), "file_path")
    return graph.edges.join(f, "source").groupBy("file_path").agg(F.count(F.lit(1)).alias("edges")).orderBy(F.desc("edges"), "file_path").limit(top)


_BANNED = frozenset("insert update delete create drop alter truncate merge grant revoke load set reset cache uncache refresh analyze call use".split())


def raw_select(spark: SparkSession, graph: Graph, sql: str, limit: int = 1000, timeout: float = 30.0) -> DataFrame:
    """A single SELECT over ``node``, ``edge``, ``unresolved_ref``, ``file``, which stand before it as common tables; words
    that change anything are not let through, even in text. At most ``limit`` rows; a query that takes longer than
    ``timeout`` seconds is cancelled."""
    text = sql.strip().rstrip(";").strip()
    if not re.match(r"(?i)select\b", text) or ";" in text:
        raise ValueError("only a single SELECT is allowed")
    if bad := _BANNED & set(re.findall(r"[a-z]+", text.lower())):
        raise ValueError(f"not allowed: {sorted(bad)}")
    own = {f"{name}_{uuid.uuid4().hex}": (name, df) for name, df in (("node", graph.nodes), ("edge", graph.edges), ("unresolved_ref", graph.refs), ("file", graph.files))}
    tables = ", ".join(f"{name} AS (SELECT * FROM {view})" for view, (name, _) in own.items())
    for view, (_, df) in own.items():
        df.createOrReplaceTempView(view)
    try:
        rows = spark.sql(f"WITH {tables} {text}").limit(limit)
    finally:
        for view in own:
            spark.catalog.dropTempView(view)
    tag = f"raw-{uuid.uuid4().hex}"
    clock = threading.Timer(timeout, spark.sparkContext.cancelJobGroup, [tag])
    spark.sparkContext.setJobGroup(tag, "raw select", interruptOnCancel=True)
    clock.start()
    try:
        got = rows.collect()  # at most ``limit``
    finally:
        clock.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return spark.createDataFrame(got, rows.schema)


class Store:
    """Snapshots of a graph below a folder; the newest manifest names the one that counts, and is written last."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[tuple[int, str]]:
        found = self._fs.globStatus(self._Path(f"{self.path}/manifest-*.json")) or []
        return sorted((int(re.search(r"manifest-(\d+)\.json$", str(f.getPath())).group(1)), str(f.getPath())) for f in found)

    def meta(self) -> dict[str, str]:
        found = self._manifests()
        return json.loads("".join(r[0] for r in self.spark.read.text(found[-1][1], wholetext=True).collect())) if found else {}

    def save(self, graph: Graph, **meta: str) -> str:
        snapshot = uuid.uuid4().hex
        old = self.meta()
        for name, df in graph._asdict().items():
            w = df.write
            if name == "edges":
                w = w.partitionBy("kind")
            w.parquet(f"{self.path}/{snapshot}/{name}")
        self._swap(old | meta | {"snapshot": snapshot})
        return snapshot

    def set_meta(self, **values: str) -> None:
        self._swap(self.meta() | values)

    def _swap(self, meta: dict[str, str]) -> None:
        """Write the next manifest whole and rename it to its number; readers take the newest, so one always counts."""
        found = self._manifests()
        new = self._Path(f"{self.path}/.manifest.{uuid.uuid4().hex}")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(meta, sort_keys=True).encode()))
        out.close()
        if not self._fs.rename(new, self._Path(f"{self.path}/manifest-{(found[-1][0] if found else 0) + 1}.json")):
            self._fs.delete(new, False)
            raise RuntimeError("another writer took this manifest's number")
        for _, old in found[:-1]:
            self._fs.delete(self._Path(old), False)

    def load(self) -> Graph:
        snapshot = self.meta().get("snapshot")
        if snapshot is None:
            raise FileNotFoundError(f"no graph at {self.path}")
        read = lambda n, s: self.spark.read.schema(s).parquet(f"{self.path}/{snapshot}/{n}")
        return Graph(read("nodes", NODE), read("edges", EDGE).select(*EDGE.names), read("refs", REF), read("files", FILE))
