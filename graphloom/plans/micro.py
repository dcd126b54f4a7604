"""Queries over small fixed graphs and texts, whose answers were worked out by hand: they check what SQL over the large
tables cannot say (orders of walks, ladders of strategies, kernels, routes)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics, hierarchy, resolve, search, store, synthesis, traverse
from ..schema import EDGE, FILE, NODE, REF
from ..sources import bindings, frameworks

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(columns: str, *rows: str):
    """The answer: column names and rows of SQL literals."""

    def add(f):
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = f"SELECT * FROM (VALUES {', '.join(f'({r})' for r in rows)}) AS t({columns})"
        return f

    return add


def node(i: str, kind: str = "function", name: str | None = None, qualified: str | None = None, file: str | None = None, language: str = "python", line: int = 1, end: int = 9, exported: bool | None = None) -> tuple:
    own = dict.fromkeys(NODE.names) | {"id": i, "kind": kind, "name": name or i, "qualified_name": qualified or name or i, "file_path": file or f"src/{i}.py", "language": language, "start_line": line, "end_line": end, "is_exported": exported, "decorators": [], "type_parameters": []}
    return tuple(own[c] for c in NODE.names)


def ref(source: str, name: str, kind: str = "calls", line: int = 5, file: str = "a/x.py", language: str = "python") -> tuple:
    own = dict.fromkeys(REF.names) | {"from_node_id": source, "reference_name": name, "reference_kind": kind, "line": line, "file_path": file, "language": language, "candidates": [], "status": "pending", "name_tail": name.split(".")[-1]}
    return tuple(own[c] for c in REF.names)


def graph(spark: SparkSession, edges: Sequence[tuple], nodes: Sequence[tuple] = (), refs: Sequence[tuple] = ()) -> store.Graph:
    """Edges ``source, target, kind[, line]``; ends that are not among ``nodes`` are functions named after their ids."""
    known = {n[NODE.names.index("id")] for n in nodes}
    all_nodes = [*nodes, *(node(i) for i in sorted({x for e in edges for x in e[:2]} - known))]
    es = [(a, b, k, None, line[0] if line else None, None, None) for a, b, k, *line in edges]
    return store.Graph(spark.createDataFrame(all_nodes, NODE), spark.createDataFrame(es, EDGE), spark.createDataFrame(list(refs), REF), spark.createDataFrame([], FILE))


def _ids(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


# -- walks -----------------------------------------------------------------------------------------------------------
_CAP = [("root", "A", "calls"), ("root", "B", "calls"), ("A", "B", "calls"), ("B", "C", "calls")]


@query("mode, id, depth", "'exact', 'A', 1", "'exact', 'B', 2", "'bfs', 'A', 1", "'bfs', 'B', 1", "'bfs', 'C', 2")
def t1_micro_modes(spark, d):
    """Depth first, B is met through A at the cap; by levels it is met earlier and leads to C."""
    g = graph(spark, _CAP)
    exact = traverse.exact_walk(g, "root", 2, "out").select(F.lit("exact").alias("mode"), "id", F.col("depth").cast("int").alias("depth"))
    return exact.unionByName(traverse.callees(g, _ids(spark, "root"), 2).select(F.lit("bfs").alias("mode"), "id", "depth"))


@query("pos, id, kind, line", "0, 'a', NULL, NULL", "1, 'c', 'calls', 1", "2, 'd', 'calls', NULL", "3, 'e', 'calls', 4")
def t3_micro_path(spark, d):
    """Of two ways of three hops the one whose first edge comes first."""
    return traverse.find_path(graph(spark, [("a", "b", "calls", 5), ("b", "d", "calls"), ("a", "c", "calls", 1), ("c", "d", "calls"), ("d", "e", "calls", 4), ("x", "a", "calls"), ("a", "q", "calls"), ("q", "r", "calls"), ("r", "s", "calls"), ("s", "e", "calls")]), "a", "e")


@query("id, depth, ord", "'hub', 0, 0", "'z', 1, 1", "'n0', 1, 2", "'n1', 1, 3")
def t5_micro_traverse(spark, d):
    """A cap of four nodes: what the hub contains comes before what it calls."""
    g = graph(spark, [*(("hub", f"n{i}", "calls") for i in range(9)), ("hub", "z", "contains"), ("n0", "far", "calls")])
    return traverse.traverse(g, "hub", 2, "out", limit=4)[0].select("id", "depth", "ord")


@query("id, depth", "'C', 0", "'m1', 0", "'m2', 0", "'u', 1", "'v', 2")
def t2_micro_impact(spark, d):
    g = graph(spark, [("C", "m1", "contains"), ("C", "m2", "contains"), ("u", "m1", "calls"), ("v", "u", "calls"), ("w", "v", "calls")], [node("C", "class"), node("m1", "method"), node("m2", "method")])
    return traverse.exact_impact(g, "C", 2)[0].select("id", "depth")


# -- kernels ---------------------------------------------------------------------------------------------------------
@query("first, members", "'a', 3", "'d', 3")
def a4_micro_communities(spark, d):
    """Two triangles and a bridge."""
    e = [("a", "b", "calls"), ("b", "c", "calls"), ("a", "c", "calls"), ("d", "e", "calls"), ("e", "f", "calls"), ("d", "f", "calls"), ("c", "d", "calls")]
    return analytics.communities(graph(spark, e).edges).groupBy("community").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("members")).select("first", "members")


@query("id, betweenness", "'p1', 2.0::DOUBLE", "'p2', 2.0::DOUBLE", "'l', 0.5::DOUBLE", "'r', 0.5::DOUBLE")
def a6_micro_betweenness(spark, d):
    """A path of four and a diamond."""
    e = [("p0", "p1", "calls"), ("p1", "p2", "calls"), ("p2", "p3", "calls"), ("t", "l", "calls"), ("t", "r", "calls"), ("l", "b", "calls"), ("r", "b", "calls")]
    return analytics.betweenness(graph(spark, e).edges).filter("betweenness > 0")


@query("component, id", "'a', 'a'", "'a', 'b'", "'a', 'c'", "'x', 'x'", "'x', 'y'")
def a5_micro_components(spark, d):
    e = [("a", "b", "calls"), ("b", "c", "calls"), ("c", "a", "calls"), ("c", "t", "calls"), ("x", "y", "calls"), ("y", "x", "calls"), ("s", "s", "calls")]
    return analytics.strong_components(graph(spark, e).edges)


@query("node_id, cycle_id", "'a', 'c'", "'b', 'c'", "'c', 'c'", "'s', 's'")
def micro_cycles(spark, d):
    """A cycle that a root leads to, a node that is its own parent, and nodes below cycles."""
    e = [("r", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "t"), ("s", "s"), ("s", "u")]
    return hierarchy.cycle_nodes(hierarchy.links(spark.createDataFrame([("k", *x) for x in e], "kind string, source string, target string"))).select("node_id", "cycle_id")


# -- search ----------------------------------------------------------------------------------------------------------
@query("id, score", "'b', 0.03306::DOUBLE", "'a', 0.016667::DOUBLE", "'c', 0.016393::DOUBLE")
def k6_micro_fusion(spark, d):
    """Two lists that share their second and first member: 1/61 + 1/60 comes first."""
    rows = lambda *x: search.ranked(spark.createDataFrame([(i, float(len(x) - n), i) for n, i in enumerate(x)], "id string, score double, name string"))
    return search.reciprocal_rank_fusion(rows("a", "b"), rows("b", "c")).select("id", F.round("score", 6).alias("score"))


# -- resolution ------------------------------------------------------------------------------------------------------
_NODES = [
    node("load_a", name="load", file="a/x.py"), node("load_b", name="load", file="b/y.py"), node("caller", name="caller", file="a/x.py", line=2), node("Store", "class", file="a/s.py"), node("get", "method", "get", "Store::get", "a/s.py", line=3),
    node("Shape", "interface", file="a/i.ts", language="typescript"), node("Square", "class", file="a/q.ts", language="typescript"), node("lone", name="lone", file="c/z.rs", language="rust"), node("fold", name="foldAll", file="d/f.py"), node("file:a/s.py", "file", "s.py", "a/s.py", "a/s.py"),
    node("helper", name="helper", file="lib/h.py", exported=True), node("helper2", name="helper", file="q/h.py"),
]


@query("name, target, confidence, resolved_by",
    "'load', 'load_a', 0.7::DOUBLE, 'exact-match'", "'Store::get', 'get', 0.95::DOUBLE, 'qualified-name'", "'Store.get', 'get', 0.95::DOUBLE, 'qualified-name'", "'store.get', 'get', 0.8::DOUBLE, 'instance-method'", "'thing.get', 'get', 0.7::DOUBLE, 'instance-method'",
    "'lone', 'lone', 0.5::DOUBLE, 'exact-match'", "'Store.FOLDALL', 'fold', 0.5::DOUBLE, 'fuzzy'", "'a/s.py', 'file:a/s.py', 0.95::DOUBLE, 'file-path'", "'Store', 'Store', 0.9::DOUBLE, 'exact-match'", "'helper', 'helper', 0.9::DOUBLE, 'import'")
def r13_micro_ladder(spark, d):
    """One reference for each rung; ``print`` is known to the language, ``absent`` and ``FOLDALL`` to nobody."""
    names = ("load", "Store::get", "Store.get", "store.get", "thing.get", "lone", "FOLDALL", "Store.FOLDALL", "Store", "helper", "print", "absent")
    refs = [*(ref("caller", n) for n in names), ref("caller", "a/s.py", "imports")]
    imports = spark.createDataFrame([("a/x.py", "helper", "helper", "lib/h.py")], "file_path string, local string, exported string, module_file string")
    return resolve.resolve(graph(spark, [("caller", "load_a", "contains")], _NODES, refs), imports=imports).select(F.col("reference_name").alias("name"), "target", "confidence", "resolved_by")


@query("target, kind", "'Store', 'instantiates'", "'Shape', 'implements'", "'load_a', 'calls'")
def r14_micro_promotions(spark, d):
    """A called class is instantiated, an extended interface implemented."""
    refs = [ref("caller", "Store"), ref("Square", "Shape", "extends", file="a/q.ts", language="typescript"), ref("caller", "load")]
    g = graph(spark, [("caller", "load_a", "contains")], _NODES, refs)
    return resolve.to_edges(resolve.resolve(g), g.nodes).select("target", "kind")


@query("file, name, origin_file, origin_name", "'lib.ts', 'A', 'lib.ts', 'A'", "'mid.ts', 'A', 'lib.ts', 'A'", "'index.ts', 'B', 'lib.ts', 'A'")
def r8c_micro_exports(spark, d):
    """A star and a renamed re-export, followed to the declaration; a cycle of stars ends."""
    rows = [("lib.ts", "A", None, None), ("mid.ts", "*", "lib.ts", "*"), ("mid.ts", "*", "mid.ts", "*"), ("index.ts", "B", "mid.ts", "A")]
    return resolve.chase_exports(spark.createDataFrame(rows, "file string, name string, from_file string, from_name string"))


@query("receiver, type_name", "'a', 'Store'", "'b', 'Repo'", "'r', 'Vec'")
def r10i_micro_receivers(spark, d):
    """A new value, a dotted annotation, a generic one; ``k`` is given no type."""
    texts = [("a.ts", "const a = new pkg.Store<T>(1);\na.get();\n"), ("b.py", "def f(b: models.Repo, k):\n    b.get()\n    k.get()\n"), ("c.rs", "fn f() {\n    let r: Vec<u8> = make();\n    r.get();\n}\n")]
    refs = [ref("f", "a.get", line=2, file="a.ts", language="typescript"), ref("g", "b.get", line=2, file="b.py"), ref("g", "k.get", line=3, file="b.py"), ref("h", "r.get", line=3, file="c.rs", language="rust")]
    g = graph(spark, [("f", "g", "calls"), ("g", "h", "calls")], refs=refs)
    return bindings.receiver_types(g.refs, g.nodes, spark.createDataFrame(texts, "path string, text string")).select("receiver", "type_name")


# -- frameworks, run-time calls --------------------------------------------------------------------------------------
_ROUTES = [
    ("a.js", "app.get('/x', auth, ctl.list)\n// app.get('/no', y)\napp.use(z)\n"),
    ("f.py", '@app.route("/h", methods=["POST"])\ndef h(): pass\n'),
    ("api.py", '@router.get("/items/{id}")\nasync def item(id): pass\n'),
    ("urls.py", "urlpatterns = [path('users/', views.users)]\n"),
    ("C.java", '@RestController\n@RequestMapping("/api")\nclass C {\n  @GetMapping("/v")\n  public String v() { return ""; }\n}\n'),
    ("m.go", 'package m\nfunc r(g *gin.Engine) {\n\tg.GET("/ping", ping)\n}\n'),
    ("routes.rb", "get '/posts', to: 'posts#index'\n"),
    ("web.php", "<?php\nRoute::get('/u', [UserController::class, 'index']);\n"),
]


@query("path, name", "'a.js', 'GET /x'", "'f.py', 'POST /h'", "'api.py', 'GET /items/{id}'", "'urls.py', 'users/'", "'C.java', 'GET /api/v'", "'m.go', 'GET /ping'", "'routes.rb', 'GET /posts'", "'web.php', 'GET /u'")
def fw_micro_routes(spark, d):
    """One route of each kind of declaration; a route in a comment is none."""
    return frameworks.routes(spark.createDataFrame(_ROUTES, "path string, text string")).select(F.col("file_path").alias("path"), "name")


@query("source, target, kind", "'emitter', 'onSave', 'calls'")
def y_micro_events(spark, d):
    """An event with a named handler; an anonymous one gives no edge."""
    nodes = [node("emitter", name="emitter", file="e.js", language="javascript", line=1, end=3), node("setup", name="setup", file="h.js", language="javascript", line=1, end=4), node("onSave", name="onSave", file="h.js", language="javascript", line=5, end=6)]
    texts = [("e.js", "javascript", "function emitter() {\n  bus.emit('save', 1)\n}\n"), ("h.js", "javascript", "function setup() {\n  bus.on('save', onSave)\n  bus.on('load', () => {})\n}\nfunction onSave() {\n}\n")]
    g = graph(spark, [("setup", "onSave", "contains")], nodes)
    return synthesis.synthesize(g, spark.createDataFrame(texts, "file_path string, language string, text string")).select("source", "target", "kind")


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
