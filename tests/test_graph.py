import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import analytics, relevance, resolve, search, store, synthesis, traverse
from graphloom.schema import EDGE, FILE, NODE, REF


def graph(spark, edges, kinds=None, refs=(), nodes=()):
    """A small graph; nodes are named after their ids."""
    kinds = kinds or {}
    ids = sorted({x for e in edges for x in e[:2]} | set(kinds))
    rows = [dict.fromkeys(NODE.names) | {"id": i, "kind": kinds.get(i, "function"), "name": i, "qualified_name": i, "file_path": f"src/{i}.py", "language": "python", "start_line": 1, "end_line": 9, "decorators": [], "type_parameters": []} for i in ids]
    rows += [dict.fromkeys(NODE.names) | {"decorators": [], "type_parameters": []} | n for n in nodes]
    es = [(a, b, k, None, line[0] if line else None, None, None) for a, b, k, *line in edges]
    return store.Graph(spark.createDataFrame([tuple(r[c] for c in NODE.names) for r in rows], NODE), spark.createDataFrame(es, EDGE), spark.createDataFrame(list(refs), REF), spark.createDataFrame([], FILE))


def ids(df, *cols):
    cols = cols or ("id",)
    return sorted(tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect())


def start(spark, *x):
    return spark.createDataFrame([(i,) for i in x], "id string")


def test_depth_cap_differs(spark):
    g = graph(spark, [("root", "A", "calls"), ("root", "B", "calls"), ("A", "B", "calls"), ("B", "C", "calls")])
    assert ids(traverse.exact_walk(g, "root", 2, "out")) == ["A", "B"]
    assert ids(traverse.callees(g, start(spark, "root"), 2)) == ["A", "B", "C"]


def test_exact_walk_of_any_size(spark, monkeypatch):
    """The order as in the definition, with no edges refused or sent to the driver."""
    monkeypatch.setattr(traverse, "EXACT_EDGES", 1)
    rnd = random.Random(3)
    for n, depth in ((6, 0), (8, 2), (14, 3)):
        edges = sorted({(f"n{rnd.randrange(n):02}", f"n{rnd.randrange(n):02}", rnd.choice(["calls", "references"]), rnd.randrange(9)) for _ in range(3 * n)} | {("n01", "n00", "calls", 1)})
        g, seen, want = graph(spark, edges), {"n00"}, []

        def visit(at, level):
            for there, kind, line in sorted(((s, k, line) for s, t, k, line in edges if t == at), key=lambda e: (e[1] != "calls", e[2], e[0])):  # noqa: B023
                if there not in seen:  # noqa: B023
                    seen.add(there)  # noqa: B023
                    want.append((there, level + 1, len(want), there, at, kind, line))  # noqa: B023
                    if level + 1 < depth:  # noqa: B023
                        visit(there, level + 1)  # noqa: B023

        visit("n00", 0)
        got = traverse.exact_walk(g, "n00", depth, "in")
        assert [tuple(r) for r in got.select("id", "depth", "ord", "source", "target", "kind", "line").collect()] == want
    assert traverse.exact_walk(g, "alone", 2, "in").count() == 0


def test_edges_keep_their_identity(spark):
    g = graph(spark, [("X", "Y", "calls", 3), ("X", "Y", "calls", 9), ("X", "Y", "references"), ("X", "Y", "references"), ("X", "gone", "calls")])
    known = g.nodes.filter("id != 'gone'")
    assert store.insert_edges(g.edges, known).count() == 3
    assert store.insert_edges(g.edges, known, store.insert_edges(g.edges, known)).count() == 0


def test_impact(spark):
    kinds = {"C": "class", "m1": "method", "m2": "method"}
    g = graph(spark, [("C", "m1", "contains"), ("C", "m2", "contains"), ("u", "m1", "calls"), ("v", "u", "calls")], kinds)
    assert ids(traverse.impact(g, start(spark, "m1"), 1), "id", "depth") == [("m1", 0), ("u", 1)]
    assert ids(traverse.impact(g, start(spark, "C"), 0), "id", "depth") == [("C", 0), ("m1", 0), ("m2", 0)]
    nodes, edges = traverse.exact_impact(g, "C", 2)
    assert ids(nodes, "id", "depth") == [("C", 0), ("m1", 0), ("m2", 0), ("u", 1), ("v", 2)] and edges.count() == 4


def test_paths(spark):
    g = graph(spark, [("a", "b", "calls", 5), ("b", "d", "calls"), ("a", "c", "calls", 1), ("c", "d", "calls"), ("d", "e", "calls"), ("x", "a", "calls")])
    way = lambda a, b: [r["id"] for r in traverse.find_path(g, a, b).orderBy("pos").collect()]
    assert way("a", "e") == ["a", "c", "d", "e"] and way("a", "a") == ["a"] and way("e", "a") == [] and way("a", "zz") == []


def test_hierarchy_and_cycles_end(spark):
    g = graph(spark, [("a", "b", "extends"), ("b", "c", "extends"), ("c", "a", "extends"), ("d", "a", "implements")])
    got = ids(traverse.type_hierarchy(g, start(spark, "a")), "id", "relation")
    assert got == [("b", "ancestor"), ("c", "ancestor"), ("d", "descendant")]
    g = graph(spark, [("a", "b", "contains"), ("b", "a", "contains")])
    assert ids(traverse.ancestors(g, start(spark, "a")), "id", "depth") == [("b", 1)]


def test_traverse_caps_in_order(spark):
    g = graph(spark, [("hub", f"n{i:02}", "calls") for i in range(50)] + [("hub", "z", "contains")])
    nodes, edges = traverse.traverse(g, "hub", 1, "out", limit=10)
    assert ids(nodes)[:2] == ["hub", "n00"] and nodes.count() == 10 and "z" in ids(nodes)
    nodes, edges = traverse.traverse(g, "hub", 1, "both", include_start=False, limit=1000)
    assert "hub" not in ids(nodes) and edges.count() == 51


def test_bfs_matches_brute_force(spark):
    r = random.Random(8)
    edges = [(f"n{r.randrange(30)}", f"n{r.randrange(30)}", "calls") for _ in range(60)]
    g = graph(spark, edges)
    for depth in (1, 2, 4):
        want = set()
        for s in ("n1", "n2"):
            seen, level = {s: 0}, [s]
            for d in range(1, depth + 1):
                level = [b for a in level for x, b, _ in edges if x == a and b not in seen and not seen.__setitem__(b, d)]
            want |= {(s, n, d) for n, d in seen.items() if d}
        assert set(ids(traverse.callees(g, start(spark, "n1", "n2"), depth), "start_id", "id", "depth")) == want


def test_replace_file(spark):
    old = {"id": "f1", "kind": "function", "name": "f", "qualified_name": "f", "file_path": "a.py", "language": "python", "start_line": 1}
    other = old | {"id": "g1", "name": "g", "file_path": "b.py"}
    gone = old | {"id": "h1", "name": "h", "start_line": 9}
    g = graph(spark, [("g1", "f1", "calls", 4), ("g1", "h1", "calls", 5)], nodes=[old, other, gone])
    g = g._replace(nodes=g.nodes.filter("language = 'python' AND file_path IN ('a.py', 'b.py')"))
    meta = '{"refName":"h","refKind":"calls"}'
    g = g._replace(edges=g.edges.withColumn("metadata", F.when(F.col("target") == "h1", meta)))
    new = spark.createDataFrame([tuple((dict.fromkeys(NODE.names) | {"decorators": [], "type_parameters": []} | old | {"id": "f2", "start_line": 3})[c] for c in NODE.names)], NODE)
    empty = lambda s: spark.createDataFrame([], s)
    record = spark.createDataFrame([("r", "a.py", "h", "python", 1, 1, 1, 1, [])], FILE)
    out = store.replace_file(g, "a.py", new, empty(EDGE), empty(REF), record)
    assert ids(out.graph.edges, "source", "target") == [("g1", "f2")]
    assert ids(out.graph.refs, "from_node_id", "reference_name") == [("g1", "h")]
    assert {k: v.first()["n"] for k, v in out.counts.items()} == {"nodes": 1, "edges": 0, "reattached": 1, "resurrected": 1, "removed_nodes": 2}


def test_store_swaps_snapshots(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "g"))
    s.save(graph(spark, [("a", "b", "calls")]), version="1")
    s.save(graph(spark, [("a", "b", "calls"), ("b", "c", "calls")]))
    assert s.load().edges.count() == 2 and s.meta()["version"] == "1"


def test_raw_select_is_guarded(spark):
    g = graph(spark, [("a", "b", "calls")])
    assert store.raw_select(spark, g, "SELECT count(*) AS n FROM node").first()["n"] == 2
    assert store.raw_select(spark, g, "SELECT n.id, replace(e.kind, 'c', 'k') AS k FROM node n JOIN edge e ON e.source = n.id").collect() == [("a", "kalls")]
    assert not [v for v in spark.catalog.listTables() if v.name.startswith("node_")]
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2", "SELECT 'drop'", "WITH x AS (SELECT 1) SELECT 1"):
        with pytest.raises(ValueError):
            store.raw_select(spark, g, bad)


def test_a_store_survives_a_crash_before_its_manifest(spark, tmp_path, monkeypatch):
    s = store.Store(spark, str(tmp_path / "g"))
    s.save(graph(spark, [("a", "b", "calls")]), version="1")
    with monkeypatch.context() as m:
        m.setattr(store.Store, "_swap", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            s.save(graph(spark, [("a", "b", "calls"), ("b", "c", "calls")]))
    assert s.load().edges.count() == 1 and s.meta()["version"] == "1"


def test_long_ways_and_hierarchies_are_whole(spark):
    g = graph(spark, [(f"n{i:02}", f"n{i + 1:02}", "extends") for i in range(66)])
    assert [r["id"] for r in traverse.find_path(g, "n50", "n60").orderBy("pos").collect()] == [f"n{i}" for i in range(50, 61)]
    far = traverse.type_hierarchy(g, g.nodes.filter("id = 'n00'").select("id"))
    assert far.count() == 66 and far.agg({"depth": "max"}).first()[0] == 66


def test_kernels():
    two = [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (3, 4, 1.0), (4, 5, 1.0), (3, 5, 1.0), (2, 3, 1.0)]
    assert analytics.louvain_kernel(6, two) == [0, 0, 0, 1, 1, 1]
    assert analytics.tarjan_kernel(5, [(0, 1), (1, 2), (2, 0), (2, 3)]) == [[0, 1, 2]]
    assert analytics.brandes_kernel(4, [[1], [2], [3], []], range(4)) == [0, 2, 2, 0]
    assert analytics.brandes_kernel(4, [[1, 2], [3], [3], []], range(4)) == [0, 0.5, 0.5, 0]


def test_distributed_analytics(spark):
    g = graph(spark, [("a", "b", "calls"), ("b", "c", "calls"), ("c", "a", "calls"), ("c", "d", "calls")])
    assert ids(analytics.strong_components(g.edges), "component", "id") == [("a", "a"), ("a", "b"), ("a", "c")]
    assert {r["id"]: r["betweenness"] for r in analytics.betweenness(g.edges).collect()} == {"a": 1.0, "b": 2.0, "c": 3.0, "d": 0.0}
    assert analytics.communities(g.edges).count() == 4 and analytics.label_communities(g.edges).count() == 4
    assert "# Structure" in analytics.report(g)


def test_communities_of_any_size(spark, monkeypatch):
    """No number of pairs is refused; ids are numbered in order over partitions."""
    monkeypatch.setattr(analytics, "KERNEL_EDGES", 1)
    monkeypatch.setattr(analytics.communities, "__defaults__", tuple(1 if d == 5_000_000 else d for d in analytics.communities.__defaults__))
    g = graph(spark, [(f"{k}{i}", f"{k}{(i + 1) % 3}", "calls") for k in "xy" for i in range(3)] + [("x0", "x0", "calls"), ("x0", "y0", "calls")])
    got = {r["id"]: r["community"] for r in analytics.communities(g.edges.repartition(4)).collect()}
    assert got == {"x0": 0, "x1": 0, "x2": 0, "y0": 1, "y1": 1, "y2": 1}
    many = spark.range(5000).select(F.format_string("n%04d", (F.col("id") * 7919) % 5000).alias("id"))
    assert analytics.numbered(many).filter("i != cast(substr(id, 2) AS int)").count() == 0 and analytics.numbered(many).count() == 5000
    assert analytics.communities(g.edges.limit(0)).count() == 0


def test_insights_of_any_size(spark, monkeypatch):
    """The findings hold communities whatever the number of pairs."""
    monkeypatch.setattr(analytics.communities, "__defaults__", tuple(1 if d == 5_000_000 else d for d in analytics.communities.__defaults__))
    g = graph(spark, [(f"{k}{i}", f"{k}{(i + 1) % 3}", "calls") for k in ("left", "right") for i in range(3)] + [("left0", "right0", "calls")])
    got = analytics.insights(g).filter("section = 'community'").orderBy("ord").collect()
    assert [(r["ord"], r["subject"], r["value"]) for r in got] == [(0, "left0", 3.0), (1, "right0", 3.0)]


def test_louvain_moves_as_if_every_node_were_looked_at():
    """Rounds that look at all nodes, as the definition has it, against those that look at what can have changed."""
    from graphloom.operators import louvain as L

    def plain(n, pairs):
        weight, members, level = {}, list(range(n)), n
        for a, b, w in pairs:
            weight[min(a, b), max(a, b)] = weight.get((min(a, b), max(a, b)), 0.0) + w
        total = 2 * sum(weight.values())
        while True:
            near, degree = [{} for _ in range(level)], [0.0] * level
            for (a, b), w in weight.items():
                degree[a] += w
                degree[b] += w
                if a != b:
                    near[a][b] = near[b][a] = w
            com, mass = list(range(level)), degree[:]
            for _ in range(64):
                before = com[:]
                for i in range(level):
                    mass[com[i]] -= degree[i]
                    to = {com[i]: 0.0}
                    for j, w in near[i].items():
                        to[com[j]] = to.get(com[j], 0.0) + w
                    best, gain = com[i], to[com[i]] - mass[com[i]] * degree[i] / total
                    for c in sorted(to):
                        if (g := to[c] - mass[c] * degree[i] / total) > gain + 1e-12:
                            best, gain = c, g
                    mass[best] += degree[i]
                    com[i] = best
                if com == before:
                    break
            if com == list(range(level)):
                break
            number, merged = {c: k for k, c in enumerate(dict.fromkeys(com))}, {}
            for (a, b), w in weight.items():
                x, y = sorted((number[com[a]], number[com[b]]))
                merged[x, y] = merged.get((x, y), 0.0) + w
            weight, level, members = merged, len(number), [number[com[m]] for m in members]
        size = {c: (-members.count(c), members.index(c)) for c in members}
        place = {c: k for k, c in enumerate(sorted(size, key=size.get))}
        return [place[c] for c in members]

    rnd = random.Random(7)
    for _ in range(60):
        n = rnd.choice([5, 40, 150])
        pairs = [(rnd.randrange(n), 0 if rnd.random() < 0.2 else rnd.randrange(n), float(rnd.randint(1, 3))) for _ in range(4 * n)]
        with pytest.MonkeyPatch.context() as m:
            m.setattr(L, "BLOCK", rnd.choice([8, 64, 8192]))
            m.setattr(L, "MANY", rnd.choice([3, 400]))
            assert analytics.louvain_kernel(n, pairs) == plain(n, pairs)


def test_export(spark):
    g = graph(spark, [("a<b", 'q"', "calls")])
    for form in ("jsonl", "graphml", "dot"):
        lines = [r["line"] for r in analytics.export_lines(g, form).orderBy("part", "key").collect()]
        assert any("calls" in x for x in lines)
        if form == "graphml":
            from xml.etree import ElementTree

            assert len(list(ElementTree.fromstring("\n".join(lines[1:])).iter())) > 5


def test_search(spark):
    g = graph(spark, [], {"parseUser": "function", "userStore": "class", "readFile": "function"})
    assert ids(search.search_fts(g.nodes, "user")) == ["parseUser", "userStore"]
    assert search.search_fts(g.nodes, " ").count() == 0
    like = [(r["id"], r["score"]) for r in search.search_name_like(g.nodes, "user").collect()]
    assert like == [("userStore", 0.8), ("parseUser", 0.7)]
    a, b = spark.createDataFrame([("a", 0), ("b", 1)], "id string, rank int"), spark.createDataFrame([("b", 0), ("c", 1)], "id string, rank int")
    assert search.reciprocal_rank_fusion(a, b).first()["id"] == "b"


def test_resolution(spark):
    n = lambda i, name, path, kind="function", **k: {"id": i, "kind": kind, "name": name, "qualified_name": name, "file_path": path, "language": "python", "start_line": 1} | k
    nodes = [n("me", "me", "p/a.py"), n("x1", "foo", "p/a.py"), n("x2", "foo", "q/b.py"), n("k", "Box", "p/c.py", "class"), n("i", "Shape", "p/d.py", "interface"), n("js", "only", "w/e.ts", language="typescript"), n("imp", "foo", "p/z.py", "import"), n("m", "run", "p/c.py", "method", qualified_name="Box::run")]
    nodes += [n(f"c{i}", "many", f"p/m{i}.py") for i in range(501)]
    ref = lambda name, kind="calls": ("me", name, kind, 3, None, [], "p/a.py", "python", "pending", name)
    g = graph(spark, [], refs=[ref("foo"), ref("Box"), ref("Shape", "extends"), ref("only"), ref("many"), ref("Box.run"), ref("BOX"), ref("print"), ref("nothing")], nodes=nodes)
    r = resolve.resolve(g)
    got = {(x["reference_name"]): (x["target"], x["confidence"], x["resolved_by"]) for x in r.collect()}
    assert got["foo"] == ("x1", 0.7, "exact-match") and got["only"] == ("js", 0.5, "exact-match") and got["Box.run"][:2] == ("m", 0.95)
    assert "many" not in got and "print" not in got and "nothing" not in got
    kinds = {(e["target"]): e["kind"] for e in resolve.to_edges(r, g.nodes).collect()}
    assert kinds["k"] == "instantiates" and kinds["i"] == "implements"


def test_exports_and_probing(spark):
    ex = spark.createDataFrame([("a", "X", None, None), ("b", "Y", "a", "X"), ("c", "*", "b", "*"), ("d", "*", "c", "*"), ("c", "*", "d", "*")], "file string, name string, from_file string, from_name string")
    got = {(r["file"], r["name"]): (r["origin_file"], r["origin_name"]) for r in resolve.chase_exports(ex).collect()}
    assert got == {("a", "X"): ("a", "X"), ("b", "Y"): ("a", "X"), ("c", "Y"): ("a", "X"), ("d", "Y"): ("a", "X")}
    files = spark.createDataFrame([("m.ts",), ("m/index.ts",)], "path string")
    assert resolve.probe_modules(spark.createDataFrame([(1, "m")], "wanted_id int, base string"), files, [".ts", "/index.ts"]).first()["path"] == "m.ts"


def test_synthesis(spark):
    n = lambda i, a, b, kind="method", f="a.js": {"id": i, "kind": kind, "name": i, "qualified_name": i, "file_path": f, "language": "javascript", "start_line": a, "end_line": b}
    text = "class B {\n fire() {\n  this.emit('go')\n }\n}\nfunction onGo() {\n}\nbus.on('go', onGo)\nbus.on('go', () => {})\n"
    g = graph(spark, [], nodes=[n("fire", 2, 4), n("onGo", 6, 7, "function")])
    texts = spark.createDataFrame([("a.js", "javascript", text)], "file_path string, language string, text string")
    assert ids(synthesis.synthesize(g, texts), "source", "target") == [("fire", "onGo")]
    p = spark.createDataFrame([("a.js", 3), ("a.js", 9)], "file_path string, line int")
    assert ids(synthesis.enclosing_function(p, g.nodes), "line", "enclosing_id") == [(3, "fire")]


def test_relevance_helpers(spark, tmp_path):
    assert relevance.query_terms("How does `foldCache` use user_store?") == ["foldCache", "user_store"]
    assert relevance.term_groups(["cache", "foldCache", "ledger"]) == [["foldCache", "cache"], ["ledger"]]
    g = graph(spark, [("foldCache", "ledger", "calls"), ("ledger", "store", "calls")])
    assert relevance.relevant(g, "foldCache ledger").first()["name"] in ("foldCache", "ledger")
    assert "foldCache" in relevance.explore(g, "foldCache ledger")
    m = relevance.Memory(spark, str(tmp_path / "m"))
    m.remember(1, "where is the cache", "x")
    m.remember(2, "ledger", "cache flush")
    assert [t for t, _, _ in m.recall("cache ledger")] == [2, 1]
