"""Graph traversals.

``bfs`` walks level by level for any number of start nodes at once: a level is one join of the frontier with the edges
and one aggregation, written to the shared folder; payload columns are joined once, at the end. ``exact`` replays the
depth-first order of a single walk, in which a node is visited before its depth is looked at, so that under a depth cap
some nodes stay unexpanded; only the edges within reach of the start are brought together for that: of a walk as numbers
in one task, of ``exact_impact`` on the driver, where the number of them is checked first.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import CALL_KINDS, CONTAINER_KINDS, HIERARCHY_KINDS
from ..session import Levels, checkpoint
from .analytics import numbered
from .store import Graph, file_dependencies

#: Most edges that ``exact_impact`` brings together.
EXACT_EDGES = 2_000_000


def rank(kind: Column) -> Column:
    """The order of adjacent edges begins with contains, then calls, then the others."""
    return F.when(kind == "contains", 0).when(kind == "calls", 1).otherwise(2)


def clamp_limit(n: int) -> int:
    return max(1, min(100, n))


def clamp_depth(n: int) -> int:
    return 2 if n == 0 else max(1, min(10, n))


def _order(neighbour: str) -> list[Column]:
    return [rank(F.col("kind")), F.coalesce("line", F.lit(-1)), F.col(neighbour), F.col("kind"), F.coalesce("column_no", F.lit(-1))]


def steps(edges: DataFrame, direction: str) -> DataFrame:
    """``here, there`` and the edge, in the walk's direction: out, in or both."""
    out = edges.select(F.col("source").alias("here"), F.col("target").alias("there"), "*")
    back = edges.select(F.col("target").alias("here"), F.col("source").alias("there"), "*")
    return out if direction == "out" else back if direction == "in" else out.unionByName(back)


def bfs(edges: DataFrame, starts: DataFrame, depth: int | None, direction: str = "out") -> DataFrame:
    """``start_id, id, depth``: all nodes within ``depth`` steps (None: any number) of each start (column ``id``), starts
    not included."""
    pairs = steps(edges, direction).select("here", "there").filter("here != there").distinct()
    begin = starts.select(F.col("id").alias("start_id"), "id").distinct()
    further = lambda front: front.select("start_id", F.col("id").alias("here")).join(pairs, "here").select("start_id", F.col("there").alias("id")).distinct()
    if depth is not None and depth <= 2:
        seen, front = begin.withColumn("depth", F.lit(0)), begin
        for level in range(1, depth + 1):
            front = further(front).join(seen.select("start_id", "id"), ["start_id", "id"], "left_anti")
            seen = seen.unionByName(front.withColumn("depth", F.lit(level)))
        return seen.filter("depth > 0")
    pairs = checkpoint(pairs)
    levels = Levels(edges.sparkSession, "start_id string, id string", "met")
    new = begin
    while (front := levels.add(new.withColumn("met", F.lit(True)))) is not None and (depth is None or levels.n < depth):
        new = further(front).join(levels.all().select("start_id", "id"), ["start_id", "id"], "left_anti")
    return levels.all().select("start_id", "id", F.col("level").alias("depth")).filter("depth > 0")


def callers(graph: Graph, starts: DataFrame, depth: int = 2) -> DataFrame:
    return bfs(graph.edges.filter(F.col("kind").isin(*CALL_KINDS)), starts, depth, "in")


def callees(graph: Graph, starts: DataFrame, depth: int = 2) -> DataFrame:
    return bfs(graph.edges.filter(F.col("kind").isin(*CALL_KINDS)), starts, depth, "out")


def _adjacency(edges: DataFrame, reach: DataFrame, direction: str, start: str) -> dict[str, list[tuple]]:
    """Adjacent edges of the nodes in reach, in order."""
    here = reach.select(F.col("id").alias("here")).union(reach.sparkSession.createDataFrame([(start,)], "here string")).distinct()
    near = steps(edges, direction).join(here, "here", "left_semi").select("here", "there", "source", "target", "kind", "line", "column_no", rank(F.col("kind")).alias("rank"))
    rows = near.limit(EXACT_EDGES + 1).collect()
    if len(rows) > EXACT_EDGES:
        raise ValueError(f"more than {EXACT_EDGES} edges within reach; use bfs")
    out: dict[str, list[tuple]] = defaultdict(list)
    minus = lambda x: -1 if x is None else x
    for r in sorted(rows, key=lambda r: (r.rank, minus(r.line), r.there, r.kind, minus(r.column_no))):
        out[r.here].append((r.there, r.source, r.target, r.kind, r.line, r.column_no))
    return out


def walk_kernel(n: int, start: int, here: np.ndarray, there: np.ndarray, rank: np.ndarray, line: np.ndarray, depth: int) -> tuple[array, array, array]:
    """Node, depth and previous node of each node in the depth-first order; edges go by rank, line and there."""
    order = np.lexsort((there, line, rank, here))
    begin = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(here, minlength=n), out=begin[1:])
    begin, near = array("q", begin.tobytes()), array("i", there[order].astype(np.int32).tobytes())
    seen, out, levels, by = bytearray(n), array("i"), array("i"), array("i")
    seen[start] = 1
    stack = [(iter(range(begin[start], begin[start + 1])), start)]
    while stack:
        it, at = stack[-1]
        for k in it:
            to = near[k]
            if seen[to]:
                continue
            seen[to] = 1
            out.append(to)
            levels.append(len(stack))
            by.append(at)
            if len(stack) < depth:
                stack.append((iter(range(begin[to], begin[to + 1])), to))
                break
        else:
            stack.pop()
    return out, levels, by


def exact_walk(graph: Graph, start: str, depth: int, direction: str, kinds: Iterable[str] = CALL_KINDS) -> DataFrame:
    """Callers or callees in the depth-first order, each once with the edge that reached it first. Only nodes nearer than
    ``depth`` are ever expanded; the order is replayed in one task, which is sent the numbers of their first edges."""
    spark = graph.edges.sparkSession
    begin = spark.createDataFrame([(start,)], "id string")
    edges = checkpoint(graph.edges.filter(F.col("kind").isin(*kinds)).select("source", "target", "kind", "line", "column_no"))
    here = bfs(edges, begin, max(depth, 1) - 1, direction).select("id").union(begin).select(F.col("id").alias("here"))
    near = steps(edges, direction).join(here, "here", "left_semi").filter("here != there")
    order = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(_order("there"))], "source", "target", "kind", "line", "column_no")
    first = checkpoint(near.groupBy("here", "there").agg(F.min(order).alias("s")))
    names = checkpoint(numbered(first.select(F.col("here").alias("id")).union(first.select("there")).union(begin)))
    first = first.join(names.select(F.col("id").alias("here"), F.col("i").alias("x")), "here").join(names.select(F.col("id").alias("there"), F.col("i").alias("y")), "there")
    first = checkpoint(first.select(F.col("there").alias("id"), "x", "y", "s"))
    n, root = names.count(), names.filter(F.col("id") == start).first()["i"]

    def run(batches):
        got = [[np.asarray(c) for c in batch.columns] for batch in batches]
        if not got:
            return
        x, y, r, at = (np.concatenate(c) for c in zip(*got))
        del got
        out, levels, by = (np.asarray(c) for c in walk_kernel(n, root, x, y, r, at, depth))
        for k in range(0, len(out), 65536):
            part = slice(k, k + 65536)
            yield pa.RecordBatch.from_arrays([pa.array(by[part]), pa.array(out[part]), pa.array(levels[part]), pa.array(np.arange(k, k + len(out[part]), dtype=np.int32))], ["x", "y", "depth", "ord"])

    ints = first.select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col("s.o0").alias("r"), F.col("s.o1").alias("at"))
    walked = checkpoint(ints.repartition(1).mapInArrow(run, "x int, y int, depth int, ord int"))
    return first.join(walked, ["x", "y"]).select("id", "depth", "ord", *[f"s.{c}" for c in ("source", "target", "kind", "line", "column_no")]).orderBy("ord")


def impact(graph: Graph, starts: DataFrame, depth: int) -> DataFrame:
    """``start_id, id, depth``: what a change reaches. Children of containers belong to them at the same depth;
    all other edges are followed backwards; containment is never followed upwards."""
    kind_of = graph.nodes.select("id", F.col("kind").isin(*CONTAINER_KINDS).alias("container"))
    inside = graph.edges.filter("kind = 'contains'").select(F.col("source").alias("id"), F.col("target").alias("child")).distinct()
    inside = checkpoint(inside.join(kind_of.filter("container").select("id"), "id", "left_semi"))
    back = checkpoint(graph.edges.filter("kind != 'contains'").select(F.col("target").alias("id"), F.col("source").alias("by")).distinct())

    def closed(new: DataFrame, seen: DataFrame | None, level: int) -> DataFrame:
        got = new
        while True:
            kids = new.join(inside, "id").select("start_id", F.col("child").alias("id")).distinct().join(got.select("start_id", "id"), ["start_id", "id"], "left_anti")
            if seen is not None:
                kids = kids.join(seen.select("start_id", "id"), ["start_id", "id"], "left_anti")
            kids = checkpoint(kids)
            if kids.isEmpty():
                return got.select("start_id", "id", F.lit(level).alias("depth"))
            got, new = got.unionByName(kids), kids

    seen = front = closed(checkpoint(starts.select(F.col("id").alias("start_id"), "id").distinct()), None, 0)
    for level in range(1, depth + 1):
        new = front.join(back, "id").select("start_id", F.col("by").alias("id")).distinct().join(seen.select("start_id", "id"), ["start_id", "id"], "left_anti")
        new = checkpoint(new)
        if new.isEmpty():
            break
        front = closed(new, seen, level)
        seen = seen.unionByName(front)
    return seen


def exact_impact(graph: Graph, start: str, depth: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (``id, depth``) and edges of the depth-first impact walk; every edge into a visited node is recorded."""
    spark = graph.edges.sparkSession
    reach = impact(graph, spark.createDataFrame([(start,)], "id string"), depth)
    back = _adjacency(graph.edges, reach, "in", start)
    down = _adjacency(graph.edges.filter("kind = 'contains'"), reach, "out", start)
    ids = reach.select("id").union(spark.createDataFrame([(start,)], "id string")).distinct()
    kinds = {r["id"]: r["kind"] for r in graph.nodes.join(ids, "id", "left_semi").select("id", "kind").collect()}  # ends of those edges
    nodes: dict[str, int] = {start: 0}
    edges: dict[tuple, None] = {}
    stack = [(start, 0)]
    visited: set[str] = set()
    while stack:
        at, level = stack.pop()
        if at in visited:
            continue
        visited.add(at)
        todo = []
        if kinds.get(at) in CONTAINER_KINDS:
            for there, *edge in down.get(at, ()):
                edges[tuple(edge)] = None
                if there not in nodes:
                    nodes[there] = level
                    todo.append((there, level))
        if level < depth:
            for there, *edge in back.get(at, ()):
                if edge[2] == "contains":
                    continue
                edges[tuple(edge)] = None
                if there not in nodes:
                    nodes[there] = level + 1
                    todo.append((there, level + 1))
        stack += reversed(todo)
    return spark.createDataFrame(sorted(nodes.items()), "id string, depth int"), spark.createDataFrame([*edges], "source string, target string, kind string, line int, column_no int")


def find_path(graph: Graph, start: str, goal: str, kinds: Iterable[str] = ()) -> DataFrame:
    """``pos, id, kind, line``: the shortest path along outgoing edges, the first in the order of adjacent edges; empty
    if there is none. Levels go out from the start until one has the goal; back from there only nodes on shortest paths
    are kept; on them the path takes the first edge from each node."""
    spark = graph.edges.sparkSession
    schema = "pos int, id string, kind string, line int"
    known = graph.nodes.filter(F.col("id").isin(start, goal)).select("id").distinct().count()
    if known < len({start, goal}):
        return spark.createDataFrame([], schema)
    if start == goal:
        return spark.createDataFrame([(0, start, None, None)], schema)
    e = graph.edges.filter(F.col("kind").isin(*kinds)) if kinds else graph.edges
    e = e.filter("source != target").withColumn("_o", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(_order("target"))]))
    e = checkpoint(e.groupBy("source", "target").agg(F.min("_o").alias("_o")))
    levels, fronts = Levels(spark, "id string", "met"), []
    new = spark.range(1).select(F.lit(start).alias("id"))
    while (front := levels.add(new.withColumn("met", F.lit(True)))) is not None:
        fronts.append(front.select("id"))
        if not front.filter(F.col("id") == goal).isEmpty():
            break
        step = e.join(front.select(F.col("id").alias("source")), "source").select(F.col("target").alias("id")).distinct()
        new = step.join(levels.all().select("id"), "id", "left_anti")
    else:
        return spark.createDataFrame([], schema)
    on = [spark.createDataFrame([(goal,)], "id string")]
    for front in reversed(fronts[1:-1]):
        to = e.join(on[0].select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("id"))
        on.insert(0, checkpoint(front.join(to, "id", "left_semi")))
    path: list[tuple] = [(0, start, None, None)]
    for front in on:
        first = e.filter(F.col("source") == path[-1][1]).join(front.select(F.col("id").alias("target")), "target").agg(F.min(F.struct("_o", "target")).alias("m")).first()["m"]
        path.append((len(path), first["target"], first["_o"]["o3"], first["_o"]["o1"] if first["_o"]["o1"] >= 0 else None))
    return spark.createDataFrame(path, schema)


def type_hierarchy(graph: Graph, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``start_id, id, relation, depth``: ancestors (along the edges) and descendants (against them)."""
    e = graph.edges.filter(F.col("kind").isin(*HIERARCHY_KINDS))
    up = bfs(e, starts, max_depth, "out").withColumn("relation", F.lit("ancestor"))
    down = bfs(e, starts, max_depth, "in").withColumn("relation", F.lit("descendant"))
    both = up.unionByName(down).filter("id != start_id")
    first = F.min(F.struct(F.when(F.col("relation") == "ancestor", 0).otherwise(1).alias("r"), "depth", "relation")).alias("s")
    return both.groupBy("start_id", "id").agg(first).select("start_id", "id", F.col("s.relation").alias("relation"), F.col("s.depth").alias("depth"))


def traverse(graph: Graph, start: str, max_depth: int = 3, direction: str = "out", edge_kinds: Iterable[str] = (), node_kinds: Iterable[str] = (), limit: int = 1000, include_start: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes (``id, depth, ord``) and edges of a breadth-first walk. Nodes of other kinds are neither kept nor gone
    through; the cap counts nodes in the order in which they are met."""
    spark = graph.edges.sparkSession
    e = graph.edges.filter(F.col("kind").isin(*edge_kinds)) if edge_kinds else graph.edges
    ok = graph.nodes.filter(F.col("kind").isin(*node_kinds)).select(F.col("id").alias("there")) if node_kinds else graph.nodes.select(F.col("id").alias("there"))
    pairs = steps(e, direction).join(ok, "there", "left_semi")
    pairs = checkpoint(pairs.withColumn("_o", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(_order("there"))])))
    front = checkpoint(spark.range(1).select(F.lit(start).alias("id"), F.lit(0).alias("depth"), F.lit(0).alias("ord")))
    seen = front
    n = 1 if include_start else 0
    for level in range(1, max_depth + 1):
        step = front.select(F.col("id").alias("here"), "ord").join(pairs, "here").filter("here != there")
        best = step.groupBy("there").agg(F.min(F.struct("ord", "_o")).alias("m")).join(seen.select(F.col("id").alias("there")), "there", "left_anti")
        take = best.orderBy("m").limit(max(0, limit - n))
        number = F.row_number().over(W.orderBy("m"))  # at most ``limit`` rows
        new = checkpoint(take.select(F.col("there").alias("id"), F.lit(level).alias("depth"), (number + n - 1).cast("int").alias("ord")))
        k = new.count()
        if not k:
            break
        n += k
        seen, front = seen.unionByName(new), new
        if n >= limit:
            break
    inner = seen.filter(F.col("depth") < max_depth) if max_depth > 0 else seen.limit(0)
    walked = pairs.join(inner.select(F.col("id").alias("here")), "here", "left_semi").join(seen.select(F.col("id").alias("there")), "there", "left_semi")
    walked = walked.select("source", "target", "kind", F.coalesce("line", F.lit(-1)).alias("line"), F.coalesce("column_no", F.lit(-1)).alias("column_no")).distinct()
    return (seen if include_start else seen.filter(F.col("id") != start)), walked


def ancestors(graph: Graph, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``start_id, id, depth``: the chain of first containers; a cycle ends it."""
    up = graph.edges.filter("kind = 'contains'").groupBy("target").agg(F.min(F.struct(F.coalesce("line", F.lit(-1)).alias("l"), "source")).alias("s"))
    up = up.select(F.col("target").alias("id"), F.col("s.source").alias("parent"))
    return bfs(up.select(F.col("id").alias("source"), F.col("parent").alias("target")), starts, max_depth, "out")


def children(graph: Graph, ids: Iterable[str]) -> DataFrame:
    return graph.edges.filter((F.col("kind") == "contains") & F.col("source").isin(*ids)).select("source", "target").distinct()


def affected_files(graph: Graph, paths: Iterable[str], depth: int = 5) -> DataFrame:
    """``path, depth``: the files themselves and those that depend on them, directly or not."""
    spark = graph.edges.sparkSession
    deps = file_dependencies(graph).select(F.col("target_file").alias("source"), F.col("source_file").alias("target"))
    starts = spark.createDataFrame([(p,) for p in sorted(set(paths))], "id string")
    reach = bfs(deps, starts, depth, "out").groupBy("id").agg(F.min("depth").alias("depth"))
    own = starts.withColumn("depth", F.lit(0))
    return own.unionByName(reach.join(own.select("id"), "id", "left_anti")).select(F.col("id").alias("path"), "depth")


def boundaries(graph: Graph) -> DataFrame:
    """``id, boundary, n``: nodes whose calls are decided at run time: heuristic edges leave them (dynamic), or two or
    more others override or implement them (polymorphic)."""
    dynamic = graph.edges.filter("provenance = 'heuristic'").groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("n")).withColumn("boundary", F.lit("dynamic"))
    poly = graph.edges.filter("kind IN ('overrides', 'implements')").groupBy(F.col("target").alias("id")).agg(F.countDistinct("source").alias("n")).filter("n >= 2").withColumn("boundary", F.lit("polymorphic"))
    return dynamic.unionByName(poly).select("id", "boundary", "n")


def flows(graph: Graph, seeds: Iterable[str], concepts: Iterable[str] = (), max_hops: int = 7, frontier: int = 1500) -> DataFrame:
    """``path, hops, concepts``: simple call paths from the seeds, best first: more concepts, then fewer hops if any
    concept was met, else more hops. At most one unnamed node in a row; the end is named and not a value."""
    spark = graph.edges.sparkSession
    words = [c.lower() for c in concepts]
    seeds = list(seeds)[:8]
    named = graph.nodes.select(F.col("id").alias("there"), F.coalesce(F.length(F.trim("name")) > 0, F.lit(False)).alias("named"), F.col("kind").alias("k"), F.lower("name").alias("low"))
    e = graph.edges.filter(F.col("kind").isin("calls", "references", "instantiates")).select(F.col("source").alias("here"), F.col("target").alias("there")).distinct()
    e = checkpoint(e.join(named, "there"))
    gain = F.array_compact(F.array(*[F.when(F.col("low").contains(w), F.lit(w)) for w in words])) if words else F.array().cast("array<string>")
    front = checkpoint(spark.createDataFrame([(s, [s], False) for s in seeds], "here string, path array<string>, gap boolean").withColumn("met", F.array().cast("array<string>")).withColumn("end_ok", F.lit(False)))
    out = None
    for hop in range(1, max_hops + 1):
        step = front.join(e, "here").filter(~F.array_contains("path", F.col("there"))).filter(F.col("named") | ~F.col("gap"))
        step = step.select(F.col("there").alias("here"), F.concat("path", F.array("there")).alias("path"), (~F.col("named")).alias("gap"), F.array_union("met", gain).alias("met"), (F.col("named") & ~F.col("k").isin("constant", "variable", "field", "property")).alias("end_ok"))
        # the cap on the frontier is part of the operator
        front = checkpoint(step.orderBy(F.size("met").desc(), "path").limit(frontier))
        if front.isEmpty():
            break
        ends = front.filter("end_ok").select("path", F.lit(hop).alias("hops"), F.size("met").alias("concepts"))
        out = ends if out is None else out.unionByName(ends)
    if out is None:
        return spark.createDataFrame([], "path array<string>, hops int, concepts int")
    out = out.filter(F.size("path") >= 3)
    return out.orderBy(F.desc("concepts"), F.when(F.col("concepts") > 0, F.col("hops")).otherwise(-F.col("hops")), "path")
