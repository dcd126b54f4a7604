"""Structure of the graph: modules, degrees, communities, cycles, betweenness, report, picture, difference, export."""

from __future__ import annotations

import json
from collections import defaultdict, deque
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import module_of
from ..schema import LOW_SIGNAL
from ..session import checkpoint
from .hierarchy import components, links, tarjan_kernel  # noqa: F401
from .louvain import louvain
from .store import Graph

# Directories and file names that say little about structure.
NOISE_DIRS = "node_modules vendor third_party dist build target generated __generated__ __tests__ tests test spec specs __mocks__ mocks fixtures fixture e2e examples example docs doc".split()
NOISE_PARTS = (".test.", ".spec.", ".mock.", ".stories.", "_test.", "_spec.")
# Names that every program has; compared whatever their case.
TRIVIAL_NAMES = (
    "Err Some None Self Result Option Vec String Box HashMap HashSet BTreeMap usize bool new clone from into as_str as_ref to_string collect iter next unwrap expect default "
    "Default fmt Debug Display Drop len is_empty get set push insert main init drop with try_from try_into __init__ __str__ __repr__ __new__ constructor toString valueOf "
    "undefined null this super self cls prototype hashCode equals println print "
).lower().split()
MAX_MODULES = 36
#: Graphs up to this many edges fit one task of the betweenness kernel.
KERNEL_EDGES = 5_000_000
PIVOTS, EXACT_NODES = 256, 20_000


def is_noise_path(path: Column) -> Column:
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    out = F.arrays_overlap(dirs, F.array(*map(F.lit, NOISE_DIRS))) | path.endswith(".d.ts") | path.endswith(".min.js")
    for p in NOISE_PARTS:
        out = out | F.element_at(parts, -1).contains(p)
    return out


def is_trivial_name(name: Column) -> Column:
    return (F.length(name) < 3) | F.lower(name).isin(*TRIVIAL_NAMES)


def signal_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes of kinds, paths and names that matter for structure."""
    return nodes.filter(~F.col("kind").isin(*LOW_SIGNAL) & ~F.coalesce(is_noise_path(F.col("file_path")), F.lit(False)) & ~F.coalesce(is_trivial_name(F.col("name")), F.lit(True)))


def module_depth(nodes: DataFrame) -> int:
    """The deepest of 4..1 levels with at most ``MAX_MODULES`` modules, else 1."""
    row = nodes.agg(*[F.countDistinct(module_of(F.col("file_path"), d)).alias(str(d)) for d in (4, 3, 2, 1)]).first()
    return next((d for d in (4, 3, 2, 1) if row[str(d)] <= MAX_MODULES), 1)


def module_counts(nodes: DataFrame, depth: int) -> DataFrame:
    return nodes.groupBy(module_of(F.col("file_path"), depth).alias("module")).agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("file_path").alias("files"))


def module_matrix(graph: Graph, depth: int) -> DataFrame:
    """``source_module, target_module, edges`` of all edges but containment."""
    m = graph.nodes.select("id", module_of(F.col("file_path"), depth).alias("m"))
    e = graph.edges.filter("kind != 'contains'").join(m.select(F.col("id").alias("source"), F.col("m").alias("source_module")), "source").join(m.select(F.col("id").alias("target"), F.col("m").alias("target_module")), "target")
    return e.groupBy("source_module", "target_module").agg(F.count(F.lit(1)).alias("edges"))


def degrees(edges: DataFrame) -> DataFrame:
    """``id, in_degree, out_degree, degree`` in one aggregation over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count(F.lit(1)).alias("degree"))


def god_nodes(graph: Graph, top: int = 10) -> DataFrame:
    """The nodes with most edges, by degree, name and id."""
    return degrees(graph.edges).join(graph.nodes.select("id", "name", "kind"), "id").orderBy(F.desc("degree"), "name", "id").limit(top)


# -- communities -----------------------------------------------------------------------------------------------------
def louvain_kernel(n: int, pairs: Sequence[tuple[int, int, float]], max_rounds: int = 64, least: float = 1e-12) -> list[int]:
    """``louvain`` of a list of pairs."""
    a, b, w = zip(*pairs) if pairs else ((), (), ())
    return louvain(n, np.array(a, np.int64), np.array(b, np.int64), np.array(w, np.float64), max_rounds, least).tolist()


def numbered(ids: DataFrame) -> DataFrame:
    """``id, i``: distinct ids with their places in order, from 0; written once, as the places hang on the partitions."""
    rows = checkpoint(ids.distinct().orderBy("id").select("id", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    counts = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # one row a partition
    before, total = [], 0
    for r in counts:
        before.append((r["part"], total))
        total += r["n"]
    begin = F.broadcast(ids.sparkSession.createDataFrame(before, "part long, begin long"))
    return rows.withColumn("part", part).join(begin, "part").select("id", (F.col("begin") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("i"))


def communities(edges: DataFrame, most: int | None = None) -> DataFrame:
    """``id, community`` by Louvain in one task, which is sent numbers only; a graph of more than ``most`` distinct pairs
    is refused, if given: ``label_communities`` is another method with other results, to be chosen by the caller."""
    pairs = edges.filter("source != target").groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.count(F.lit(1)).alias("w"))
    pairs = checkpoint(pairs)
    if most is not None and pairs.count() > most:
        raise ValueError(f"more than {most} pairs; choose a subgraph, or label_communities")
    names = checkpoint(numbered(pairs.select(F.col("a").alias("id")).union(pairs.select("b"))))
    ints = pairs.join(names.select(F.col("id").alias("a"), F.col("i").alias("x")), "a").join(names.select(F.col("id").alias("b"), F.col("i").alias("y")), "b").select("x", "y", "w")

    def run(batches):
        got = [[np.asarray(c).astype(np.int32) for c in batch.columns] for batch in batches]
        if not got:
            return
        x, y, w = (np.concatenate(c) for c in zip(*got))
        del got
        community = louvain(int(max(x.max(), y.max())) + 1, x, y, w)
        for at in range(0, len(community), 65536):
            part = community[at : at + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), pa.array(part)], ["i", "community"])

    numbers = checkpoint(checkpoint(ints).repartition(1).mapInArrow(run, "i long, community long"))
    return names.join(numbers, "i").select("id", "community")


def label_communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """``id, community`` by label propagation, distributed: for graphs beyond one task."""
    pairs = edges.filter("source != target").select(F.col("source").alias("a"), F.col("target").alias("b"))
    pairs = checkpoint(pairs.union(pairs.select("b", "a")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("w")))
    label = checkpoint(pairs.select(F.col("a").alias("id")).distinct().withColumn("l", F.col("id")))
    for _ in range(rounds):
        votes = pairs.join(label.select(F.col("id").alias("b"), "l"), "b").groupBy("a", "l").agg(F.sum("w").alias("w"))
        label = checkpoint(votes.groupBy(F.col("a").alias("id")).agg(F.max(F.struct("w", "l")).alias("s")).select("id", F.col("s.l").alias("l")))
    size = label.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("m"))
    from pyspark.sql import Window as W

    number = size.withColumn("community", F.row_number().over(W.orderBy(F.desc("n"), "m")).cast("long") - 1)
    return label.join(number.select("l", "community"), "l").select("id", "community")


# -- cycles ----------------------------------------------------------------------------------------------------------
def strong_components(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """``component, id``: strongly connected parts of two or more nodes; named by their least member."""
    e = links(edges.select(F.lit("e").alias("kind"), F.col(source).alias("source"), F.col(target).alias("target")).filter(F.col(source) != F.col(target)))
    parts = checkpoint(components(e))
    least = parts.groupBy("cycle_id").agg(F.min("node_id").alias("component"))
    return parts.join(least, "cycle_id").select("component", F.col("node_id").alias("id"))


# -- betweenness -----------------------------------------------------------------------------------------------------
def brandes_kernel(n: int, adj: list[list[int]], sources: Iterable[int]) -> list[float]:
    """Directed betweenness of shortest paths from the sources."""
    score = [0.0] * n
    for s in sources:
        dist, sigma, order, before = [-1] * n, [0.0] * n, [], [[] for _ in range(n)]
        dist[s], sigma[s] = 0, 1.0
        todo = deque([s])
        while todo:
            v = todo.popleft()
            order.append(v)
            for w in adj[v]:
                if dist[w] < 0:
                    dist[w] = dist[v] + 1
                    todo.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    before[w].append(v)
        delta = [0.0] * n
        for w in reversed(order):
            for v in before[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                score[w] += delta[w]
    return score


def betweenness(edges: DataFrame, exact_nodes: int = EXACT_NODES, pivots: int = PIVOTS, most: int = KERNEL_EDGES) -> DataFrame:
    """``id, betweenness``: exact up to ``exact_nodes`` nodes, else from every n-th source, scaled. Sources are spread
    over tasks; the adjacency is broadcast after its size was checked."""
    spark = edges.sparkSession
    pairs = checkpoint(edges.filter("source != target").select("source", "target").distinct())
    if pairs.count() > most:
        raise ValueError(f"more than {most} edges; choose a subgraph")
    rows = pairs.collect()
    ids = sorted({x for r in rows for x in r})
    at = {x: i for i, x in enumerate(ids)}
    adj: list[list[int]] = [[] for _ in ids]
    for a, b in sorted((at[r[0]], at[r[1]]) for r in rows):
        adj[a].append(b)
    n = len(ids)
    step = 1 if n <= exact_nodes else -(-n // pivots)
    sources = list(range(0, n, step))
    if not sources:
        return spark.createDataFrame([], "id string, betweenness double")
    shared = spark.sparkContext.broadcast((ids, adj))

    def run(parts):
        for p in parts:
            ids, adj = shared.value
            for s in p["s"]:
                got = brandes_kernel(len(ids), adj, [int(s)])
                hit = [(int(s), i, v) for i, v in enumerate(got) if v]
                yield pd.DataFrame(hit, columns=["s", "i", "v"])

    tasks = min(len(sources), 4 * spark.sparkContext.defaultParallelism)
    each = spark.createDataFrame([(s,) for s in sources], "s long").repartition(tasks, "s").mapInPandas(run, "s long, i long, v double")
    # summed in the order of sources, so that the result does not depend on partitions
    total = each.groupBy("i").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("s", "v"))), F.lit(0.0), lambda a, x: a + x["v"]).alias("v"))
    names = spark.createDataFrame(list(enumerate(ids)), "i long, id string")
    return names.join(total, "i", "left").select("id", F.round(F.coalesce("v", F.lit(0.0)) * (n / len(sources)), 6).alias("betweenness"))


# -- report ----------------------------------------------------------------------------------------------------------
def import_cycles(graph: Graph, depth: int) -> DataFrame:
    """Cycles of modules over imports that no heuristic made."""
    m = graph.nodes.select("id", module_of(F.col("file_path"), depth).alias("m"))
    e = graph.edges.filter("kind = 'imports' AND coalesce(provenance, '') != 'heuristic'")
    e = e.join(m.select(F.col("id").alias("source"), F.col("m").alias("a")), "source").join(m.select(F.col("id").alias("target"), F.col("m").alias("b")), "target")
    return strong_components(e.select("a", "b"), "a", "b")


def rare_bridges(matrix: DataFrame, most: int = 2, top: int = 8) -> DataFrame:
    """Pairs of modules that only one or two edges join."""
    return matrix.filter((F.col("source_module") != F.col("target_module")) & (F.col("edges") <= most)).orderBy("edges", "source_module", "target_module").limit(top)


def orphan_modules(matrix: DataFrame, modules: DataFrame) -> DataFrame:
    """Modules that no edge joins with another."""
    far = matrix.filter("source_module != target_module")
    joined = far.select(F.col("source_module").alias("module")).union(far.select(F.col("target_module").alias("module"))).distinct()
    return modules.select("module").join(joined, "module", "left_anti")


def insights(graph: Graph) -> DataFrame:
    """``section, ord, subject, value``: communities, hubs, import cycles, rare bridges, orphan modules."""
    nodes = signal_nodes(graph.nodes)
    ids = nodes.select("id")
    inner = graph.edges.filter("kind != 'contains'").join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    inner = checkpoint(inner.select("source", "target"))
    deg = degrees(inner)
    com = checkpoint(communities(inner)).join(deg, "id").join(nodes.select("id", "name"), "id")
    hub = com.groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("degree", F.col("name"))).alias("h")).filter("n >= 2").orderBy("community").limit(12)
    depth = module_depth(graph.nodes)
    matrix = checkpoint(module_matrix(graph, depth))
    out = hub.select(F.lit("community").alias("section"), F.col("community").cast("int").alias("ord"), F.col("h.name").alias("subject"), F.col("n").cast("double").alias("value"))
    god = god_nodes(graph, 10)
    out = out.unionByName(god.select(F.lit("hub").alias("section"), F.lit(0).alias("ord"), F.col("id").alias("subject"), F.col("degree").cast("double").alias("value")))
    cyc = import_cycles(graph, depth)
    out = out.unionByName(cyc.select(F.lit("cycle").alias("section"), F.lit(0).alias("ord"), F.concat_ws(" < ", "component", "id").alias("subject"), F.lit(1.0).alias("value")))
    out = out.unionByName(rare_bridges(matrix).select(F.lit("bridge").alias("section"), F.lit(0).alias("ord"), F.concat_ws(" > ", "source_module", "target_module").alias("subject"), F.col("edges").cast("double").alias("value")))
    return out.unionByName(orphan_modules(matrix, module_counts(graph.nodes, depth)).select(F.lit("orphan").alias("section"), F.lit(0).alias("ord"), F.col("module").alias("subject"), F.lit(0.0).alias("value")))


def report(graph: Graph) -> str:
    """The findings as Markdown; each section is small by its own limits."""
    rows = defaultdict(list)
    for r in insights(graph).orderBy("section", "ord", F.desc("value"), "subject").collect():
        rows[r["section"]].append((r["subject"], r["value"]))
    titles = {"hub": "Most connected", "community": "Communities", "cycle": "Import cycles", "bridge": "Rare bridges", "orphan": "Modules on their own"}
    lines = ["# Structure"]
    for key, title in titles.items():
        lines += ["", f"## {title}", *([f"- {s} ({v:g})" for s, v in rows[key]] or ["- none"])]
    questions = [f"Why does so much depend on {s}?" for s, _ in rows["hub"][:1]] + [f"Could the cycle {s} be cut?" for s, _ in rows["cycle"][:1]] + [f"Is the bridge {s} wanted?" for s, _ in rows["bridge"][:1]]
    return "\n".join([*lines, "", "## Questions", *[f"- {q}" for q in questions]])


def picture(graph: Graph, max_nodes: int = 500) -> dict:
    """What a viewer draws: the nodes of highest degree (the cap is the feature), their distinct links, modules."""
    nodes = signal_nodes(graph.nodes)
    top = checkpoint(degrees(graph.edges).join(nodes.select("id", "name", "kind", "file_path"), "id").orderBy(F.desc("degree"), "name", "id").limit(max_nodes))
    pick = top.select("id")
    near = graph.edges.filter("source != target").select("source", "target").join(F.broadcast(pick.withColumnRenamed("id", "source")), "source", "left_semi").join(F.broadcast(pick.withColumnRenamed("id", "target")), "target", "left_semi").distinct()
    depth = module_depth(graph.nodes)
    return {
        "hidden": graph.nodes.count() - nodes.count(),
        "nodes": [r.asDict() for r in top.orderBy("id").collect()],
        "links": [tuple(r) for r in near.orderBy("source", "target").collect()],
        "modules": [tuple(r) for r in module_matrix(graph, depth).orderBy(F.desc("edges"), "source_module", "target_module").limit(MAX_MODULES**2).collect()],
        "hubs": [r["id"] for r in top.orderBy(F.desc("degree"), "name", "id").limit(5).collect()],
    }


# -- difference and export -------------------------------------------------------------------------------------------
def graph_diff(before: Graph, after: Graph) -> DataFrame:
    """``what, change, key``: nodes by id and edges by source, target and kind that came or went."""

    def change(a: DataFrame, b: DataFrame, what: str) -> DataFrame:
        went = a.join(b, "key", "left_anti").select(F.lit(what).alias("what"), F.lit("removed").alias("change"), "key")
        return went.unionByName(b.join(a, "key", "left_anti").select(F.lit(what).alias("what"), F.lit("added").alias("change"), "key"))

    n = lambda g: g.nodes.select(F.col("id").alias("key"))
    e = lambda g: g.edges.select(F.concat_ws("|", "source", "target", "kind").alias("key")).distinct()
    return change(n(before), n(after), "node").unionByName(change(e(before), e(after), "edge"))


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def export_lines(graph: Graph, form: str) -> DataFrame:
    """``part, key, line``: the graph as lines of jsonl, graphml or dot, to be written in the order of part and key.
    Nodes go by id, edges by source, target, kind and provenance."""
    n, e = graph.nodes, graph.edges
    edge_key = F.concat_ws("\u0001", "source", "target", "kind", F.coalesce("provenance", F.lit("")), F.lpad(F.coalesce("line", F.lit(-1)).cast("string"), 9, "0"))
    if form == "jsonl":
        a = F.to_json(F.struct(F.lit("node").alias("type"), *[F.col(c).alias(_camel(c)) for c in n.columns]))
        b = F.to_json(F.struct(F.lit("edge").alias("type"), *[F.col(c).alias(_camel(c)) for c in e.columns]))
        head, tail = [], []
    elif form == "graphml":
        data = lambda key, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<data key="{key}">'), _xml(F.col(c).cast("string")), F.lit("</data>"))).otherwise("")
        a = F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('">'), data("kind", "kind"), data("name", "name"), data("file", "file_path"), F.lit("</node>"))
        b = F.concat(F.lit('<edge source="'), _xml(F.col("source")), F.lit('" target="'), _xml(F.col("target")), F.lit('">'), data("ekind", "kind"), data("line", "line"), F.lit("</edge>"))
        keys = [f'<key id="{k}" for="{f}" attr.name="{m}" attr.type="{t}"/>' for k, f, m, t in (("kind", "node", "kind", "string"), ("name", "node", "name", "string"), ("file", "node", "filePath", "string"), ("ekind", "edge", "kind", "string"), ("line", "edge", "line", "int"))]
        head, tail = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *keys, '<graph edgedefault="directed">'], ["</graph>", "</graphml>"]
    elif form == "dot":
        q = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
        a = F.concat(F.lit("  "), q("id"), F.lit(" [label="), q("name"), F.lit("];"))
        b = F.concat(F.lit("  "), q("source"), F.lit(" -> "), q("target"), F.lit(" [label="), q("kind"), F.lit("];"))
        head, tail = ["digraph graph_ {"], ["}"]
    else:
        raise ValueError(f"unknown form {form}")
    out = n.select(F.lit(1).alias("part"), F.col("id").alias("key"), a.alias("line")).unionByName(e.select(F.lit(2).alias("part"), edge_key.alias("key"), b.alias("line")))
    fixed = [(0, f"{i:03}", x) for i, x in enumerate(head)] + [(3, f"{i:03}", x) for i, x in enumerate(tail)]
    return out.unionByName(n.sparkSession.createDataFrame(fixed, "part int, key string, line string")) if fixed else out


def _camel(name: str) -> str:
    a, *b = name.split("_")
    return a + "".join(x.title() for x in b)


def export(graph: Graph, form: str, path: str) -> None:
    """Write text files whose order by name is the order of lines."""
    export_lines(graph, form).orderBy("part", "key").select("line").write.text(path)


def export_json(graph: Graph) -> str:
    """One JSON document; for graphs that fit the driver."""
    rows = lambda df: [{_camel(k): v for k, v in r.asDict().items() if v is not None} for r in df.collect()]
    return json.dumps({"nodes": rows(graph.nodes.orderBy("id")), "edges": rows(graph.edges.orderBy("source", "target", "kind", "provenance", "line"))}, ensure_ascii=False, sort_keys=True)
