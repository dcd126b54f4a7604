import random

from graphloom.operators.hierarchy import ancestor_pairs, cycle_nodes, descendants, hierarchy, links, unreached


def make(spark, rows):
    return links(spark.createDataFrame([("k", a, b) for a, b in rows], "kind string, source string, target string"))


def brute_cycles(rows):
    adj = {}
    for a, b in rows:
        if a is not None and b is not None:
            adj.setdefault(a, set()).add(b)
    out = set()
    for s in adj:
        seen, todo = set(), list(adj[s])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += adj.get(x, ())
        if s in seen:
            out.add(s)
    return out


def test_cycles_match_brute_force(spark):
    r = random.Random(5)
    rows = [(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(38)] + [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("s", "s"), ("x", None), (None, "y")]
    got = {(x["kind"], x["node_id"]) for x in cycle_nodes(make(spark, rows)).collect()}
    assert got == {("k", n) for n in brute_cycles(rows)}


def test_both_ways_to_components_agree(spark, monkeypatch):
    from graphloom.operators import hierarchy as h

    r = random.Random(9)
    rows = [(f"n{r.randrange(25)}", f"n{r.randrange(25)}") for _ in range(34)] + [("s", "s")]
    e = make(spark, rows)
    few = {tuple(x) for x in h.cycle_nodes(e).collect()}
    monkeypatch.setattr(h, "KERNEL_LINKS", 0)
    assert {tuple(x) for x in h.cycle_nodes(e).collect()} == few and {n for _, n, _ in few} == brute_cycles(rows)


def test_deep_chains_are_whole(spark):
    rows = [(f"n{i:03}", f"n{i + 1:03}") for i in range(70)] + [("n000", "n005"), ("n003", "n050")]
    tree = {x["node_id"]: x for x in hierarchy(make(spark, rows)).collect()}
    assert len(tree) == 71 and tree["n070"]["depth"] == 24 and tree["n070"]["path"][:6] == ["n000", "n001", "n002", "n003", "n050", "n051"]


def test_paths_and_descendants(spark):
    rows = [("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("c", "d"), ("u", "v"), ("v", "u"), ("v", "w")]
    tree = hierarchy(make(spark, rows))
    got = {x["node_id"]: (x["depth"], x["parent_id"], x["root_id"], x["path"]) for x in tree.collect()}
    assert got == {"r": (0, None, "r", ["r"]), "a": (1, "r", "r", ["r", "a"]), "b": (1, "r", "r", ["r", "b"]), "c": (2, "a", "r", ["r", "a", "c"]), "d": (3, "c", "r", ["r", "a", "c", "d"])}
    assert {(x["ancestor_id"], x["node_id"], x["distance"]) for x in ancestor_pairs(tree).collect()} >= {("r", "d", 3), ("a", "d", 2), ("c", "d", 1)}
    assert {x["node_id"] for x in unreached(make(spark, rows)).collect()} == {"u", "v", "w"}


def brute_descendants(rows):
    adj = {}
    for a, b in rows:
        if a is not None and b is not None:
            adj.setdefault(a, set()).add(b)
    out = set()
    for s in adj:
        seen, front, n = {s}, {s}, 0
        while front:
            n += 1
            front = {y for x in front for y in adj.get(x, ())} - seen
            seen |= front
            out |= {(s, x, n) for x in front}
    return out


def pairs(frame):
    got = [(x["ancestor_id"], x["node_id"], x["distance"]) for x in frame.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_descendants_over_several_parents_and_cycles(spark):
    rows = [("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("c", "d"), ("u", "v"), ("v", "u"), ("v", "w"), ("s", "s"), ("s", "t"), ("x", None), (None, "y")]
    got = pairs(descendants(make(spark, rows)))
    assert got == brute_descendants(rows)
    assert got >= {("b", "c", 1), ("b", "d", 2), ("u", "w", 2), ("v", "u", 1)} and ("u", "u", 2) not in got


def test_descendants_match_brute_force(spark):
    for seed, nodes, n in ((1, 30, 28), (2, 20, 30)):
        r = random.Random(seed)
        rows = [(f"n{r.randrange(nodes)}", f"n{r.randrange(nodes)}") for _ in range(n)]
        assert pairs(descendants(make(spark, rows))) == brute_descendants(rows)


def test_descendants_keep_kinds_apart(spark):
    rows = spark.createDataFrame([("k", "a", "b"), ("l", "b", "c"), ("l", "c", "d")], "kind string, source string, target string")
    got = {(x["kind"], x["ancestor_id"], x["node_id"], x["distance"]) for x in descendants(links(rows)).collect()}
    assert got == {("k", "a", "b", 1), ("l", "b", "c", 1), ("l", "c", "d", 1), ("l", "b", "d", 2)}


def test_empty(spark):
    e = make(spark, []) if False else links(spark.createDataFrame([], "kind string, source string, target string"))
    assert cycle_nodes(e).count() == 0 and hierarchy(e).count() == 0


def test_no_descendants_of_nothing(spark):
    assert descendants(links(spark.createDataFrame([], "kind string, source string, target string"))).count() == 0
