"""Parent–child rows of unknown depth: paths, depths, roots, descendants and cycles.

Rows are ``(kind, parent, child)``; each kind is a hierarchy of its own and all kinds advance together. Paths grow level
by level from the roots: the frontier is joined with the rows that leave it; a child met again on a level keeps its
smallest parent, one met before is not met again. Only a child of several parents can be met twice, so only such are
compared with those met before, and they are kept apart for that.

Cycles show in what stays unreached when a node is only reached over all its parents: frontiers from the roots and from
the leaves leave the rows on and between cycles, and there the strongly connected parts are found: by one task if the
rows left are few, else by spreading the greatest name forwards and from there backwards. Every round is one written
table in the shared folder and carries keys of 128 bits instead of names.

Defined cases: rows with a null parent or child are no links; a repeated row is one link; a child with several parents
gets the path of least depth, then of the smallest parent, but is a descendant of all its parents and of all that lead to
them; nodes that no root leads to have no path and are reported as unreached, and they have descendants like any other; a
node on a cycle is reported as such and not as its own descendant; a node that is its own parent is a cycle; an empty
table gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Levels, checkpoint, drop_checkpoint, path_exists, shared_dir

#: Links that one task splits into strongly connected parts; the result does not depend on it.
KERNEL_LINKS = 500_000


def links(rows: DataFrame, kind: str = "kind", parent: str = "source", child: str = "target") -> DataFrame:
    """Distinct ``kind, parent, child`` without nulls."""
    out = rows.select(F.col(kind).alias("kind"), F.col(parent).alias("parent"), F.col(child).alias("child"))
    return out.filter("parent IS NOT NULL AND child IS NOT NULL").distinct()


def code_links(edges: DataFrame) -> DataFrame:
    """The two hierarchies of the edge table; for ``extends`` the parent is the target."""
    e = edges.filter(F.col("kind").isin("contains", "extends"))
    turn = F.col("kind") == "extends"
    return links(e.select("kind", F.when(turn, F.col("target")).otherwise(F.col("source")).alias("source"), F.when(turn, F.col("source")).otherwise(F.col("target")).alias("target")))


def _key(kind: str, name: str) -> Column:
    """128 bits that stand for a node: what the rounds carry instead of names."""
    return F.struct(F.xxhash64(F.lit(1), kind, name).alias("a"), F.xxhash64(F.lit(2), kind, name).alias("b"))


class _Steps:
    """The links of ``edges`` as keys: ``links`` (``f, t, merges``: whether others lead to ``t`` too), ``roots``, and
    ``nodes`` (``n, ins``)."""

    def __init__(self, edges: DataFrame):
        pairs = checkpoint(edges.select(_key("kind", "parent").alias("f"), _key("kind", "child").alias("t")))
        ends = pairs.select(F.explode(F.array(F.struct(F.col("f").alias("n"), F.lit(0).alias("i")), F.struct(F.col("t").alias("n"), F.lit(1).alias("i")))).alias("e"))
        self.nodes = checkpoint(ends.groupBy("e.n").agg(F.sum("e.i").alias("ins")))
        several = self.nodes.filter("ins > 1").select(F.col("n").alias("t"), F.lit(True).alias("merges"))
        self.links = checkpoint(pairs.join(several, "t", "left").select("f", "t", F.coalesce("merges", F.lit(False)).alias("merges")))
        self.roots = self.nodes.filter("ins = 0").select("n")
        drop_checkpoint(pairs)

    def depths(self) -> DataFrame:
        """``n, depth`` of all nodes that a root leads to, level by level. Links whose beginnings were met are left out of
        later rounds whenever they are half of those left."""
        levels = Levels(self.links.sparkSession, "n struct<a: bigint, b: bigint>", "merges")
        left, size, used, first = self.links, self.links.count(), 0, 0
        new = self.roots.withColumn("merges", F.lit(False))
        while (level := levels.add(new)) is not None:
            if 2 * used > size:
                since = levels.all().filter(F.col("level").between(first, levels.n - 1)).select(F.col("n").alias("f"))
                left = checkpoint(left.join(since, "f", "left_anti"))
                size, used, first = left.count(), 0, levels.n
            used += level.count()
            on = left.join(level.select(F.col("n").alias("f")), "f").select(F.col("t").alias("n"), "merges")
            again = on.filter("merges").distinct().join(levels.all().filter("merges").select("n"), "n", "left_anti")
            new = on.filter("NOT merges").unionByName(again)
        return levels.all().select("n", F.col("level").alias("depth"))

    def unreached(self, depths: DataFrame) -> DataFrame:
        """``n`` of nodes that no root leads to."""
        return self.nodes.select("n").join(depths.select("n"), "n", "left_anti")


def hierarchy(edges: DataFrame) -> DataFrame:
    """``kind, node_id, parent_id, root_id, depth, path``: all nodes that a root leads to, ``path`` from the root."""
    spark = edges.sparkSession
    base = checkpoint(edges.select("kind", "parent", "child"))
    depths = _Steps(base).depths()
    # The parent of each node: the smallest of those on the level before.
    rows = base.select("kind", "parent", "child", _key("kind", "parent").alias("f"), _key("kind", "child").alias("t"))
    rows = rows.join(depths.select(F.col("n").alias("t"), "depth"), "t").join(depths.select(F.col("n").alias("f"), F.col("depth").alias("above")), "f").filter("above = depth - 1")
    tree = rows.groupBy("kind", F.col("child").alias("node_id"), "depth").agg(F.min("parent").alias("parent_id"))
    folder = shared_dir(spark)
    tree.hint("rebalance", "depth").write.partitionBy("depth").parquet(folder)
    at = spark.read.schema("kind string, node_id string, parent_id string, depth int").option("basePath", folder)
    levels = Levels(spark, "kind string, node_id string, parent_id string, root_id string, path array<string>", "below")
    roots = base.select("kind", "parent").distinct().join(base.select("kind", F.col("child").alias("parent")).distinct(), ["kind", "parent"], "left_anti")
    new = roots.select("kind", F.col("parent").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("parent").alias("root_id"), F.array("parent").alias("path"))
    while (level := levels.add(new.withColumn("below", F.lit(True)))) is not None:
        if not path_exists(spark, f"{folder}/depth={levels.n + 1}"):
            break
        up = level.select("kind", F.col("node_id").alias("parent_id"), "root_id", F.col("path").alias("_way"))
        new = at.parquet(f"{folder}/depth={levels.n + 1}").join(up, ["kind", "parent_id"]).select("kind", "node_id", "parent_id", "root_id", F.concat("_way", F.array("node_id")).alias("path"))
    return levels.all().select("kind", "node_id", "parent_id", "root_id", F.col("level").alias("depth"), "path")


def _named(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """``kind, node_id`` of the nodes with the keys ``n``."""
    node = F.explode(F.array(F.col("parent"), F.col("child"))).alias("node_id")
    ends = edges.select("kind", node).withColumn("n", _key("kind", "node_id"))
    return ends.join(keys, "n", "left_semi").select("kind", "node_id").distinct()


def unreached(edges: DataFrame) -> DataFrame:
    """``kind, node_id`` of nodes that no root leads to: on cycles or below them."""
    base = checkpoint(edges.select("kind", "parent", "child"))
    steps = _Steps(base)
    return _named(base, steps.unreached(steps.depths()))


def between_cycles(links: DataFrame) -> DataFrame:
    """The links (``f, t``) on or between cycles. Two frontiers advance by turns, each a level at a time: from the roots to
    nodes whose parents were all reached, from the leaves to nodes whose children were; a node on a cycle waits for
    itself. What neither reaches is left, and a level's join reads only what is left."""
    now = links
    left, same, up = now.count(), 0, True
    while left and same < 2:
        a, b = ("t", "f") if up else ("f", "t")
        nxt = checkpoint(now.join(now.select(F.col(b).alias(a)).distinct(), a, "left_semi").select("f", "t"))
        n = nxt.count()
        drop_checkpoint(now)
        now, same, up, left = nxt, same + 1 if n == left else 0, not up, n
    return now


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """``kind, node_id, cycle_id``: nodes that lead back to themselves, and the greatest name of their connected part."""
    base = checkpoint(edges.select("kind", "parent", "child"))
    keys = base.withColumns({"f": _key("kind", "parent"), "t": _key("kind", "child")})
    rest = between_cycles(checkpoint(keys.select("f", "t")))
    rest = F.broadcast(rest) if rest.count() <= KERNEL_LINKS else rest
    return components(keys.join(rest, ["f", "t"], "left_semi").select("kind", "parent", "child"))


def tarjan_kernel(n: int, pairs: Iterable[tuple[int, int]]) -> list[list[int]]:
    """Strongly connected parts of two or more nodes, sorted."""
    adj: list[list[int]] = [[] for _ in range(n)]
    for a, b in sorted(set(pairs)):
        adj[a].append(b)
    index, low, on, stack, out = [-1] * n, [0] * n, [False] * n, [], []
    count = 0
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [(root, iter(adj[root]))]
        index[root] = low[root] = count
        count += 1
        stack.append(root)
        on[root] = True
        while work:
            v, it = work[-1]
            for w in it:
                if index[w] < 0:
                    index[w] = low[w] = count
                    count += 1
                    stack.append(w)
                    on[w] = True
                    work.append((w, iter(adj[w])))
                    break
                if on[w]:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while True:
                        w = stack.pop()
                        on[w] = False
                        part.append(w)
                        if w == v:
                            break
                    if len(part) > 1:
                        out.append(sorted(part))
    return sorted(out)


def _parts(pdf: pd.DataFrame) -> pd.DataFrame:
    names = sorted(set(pdf["parent"]) | set(pdf["child"]))
    at = {x: i for i, x in enumerate(names)}
    pairs = [(at[a], at[b]) for a, b in zip(pdf["parent"], pdf["child"])]
    parts = tarjan_kernel(len(names), pairs)
    alone = {a for a, b in pairs if a == b} - {x for part in parts for x in part}
    rows = [(pdf["kind"].iloc[0], names[x], names[part[-1]]) for part in [*parts, *([x] for x in sorted(alone))] for x in part]
    return pd.DataFrame(rows, columns=["kind", "node_id", "cycle_id"])


def components(edges: DataFrame) -> DataFrame:
    """``kind, node_id, cycle_id``: the strongly connected parts that have a cycle, named by their greatest node."""
    base = checkpoint(edges.select("kind", "parent", "child").distinct())
    schema = "kind string, node_id string, cycle_id string"
    if base.count() <= KERNEL_LINKS:
        return base.groupBy("kind").applyInPandas(_parts, schema)
    return _spread_parts(base, schema)


def _spread_parts(edges: DataFrame, schema: str) -> DataFrame:
    """``components`` without a bound on their size."""
    spark = edges.sparkSession
    core = edges
    found = []
    while not core.isEmpty():
        ends = core.select("kind", F.explode(F.array("parent", "child")).alias("node")).distinct()
        colour = _spread(core, ends.withColumn("c", F.col("node")), "parent", "child")
        # Backwards from each colour's own node, along links within the colour.
        a, b = colour.select("kind", F.col("node").alias("parent"), F.col("c").alias("cp")), colour.select("kind", F.col("node").alias("child"), F.col("c").alias("cc"))
        inner = checkpoint(core.join(a, ["kind", "parent"]).join(b, ["kind", "child"]).filter("cp = cc").select("kind", "parent", "child"))
        part = _spread(inner, colour.withColumn("c", F.when(F.col("node") == F.col("c"), F.col("c"))), "child", "parent").filter("c IS NOT NULL")
        loops = core.filter("parent = child").select("kind", F.col("parent").alias("node")).distinct().withColumn("_loop", F.lit(True))
        sizes = part.groupBy("kind", "c").agg(F.count(F.lit(1)).alias("_size"))
        cyc = part.join(sizes, ["kind", "c"]).join(loops, ["kind", "node"], "left").filter("_size > 1 OR _loop")
        found.append(checkpoint(cyc.select("kind", F.col("node").alias("node_id"), F.col("c").alias("cycle_id"))))
        gone = part.select("kind", "node")
        rest = core.join(gone.withColumnRenamed("node", "parent"), ["kind", "parent"], "left_anti").join(gone.withColumnRenamed("node", "child"), ["kind", "child"], "left_anti")
        core = checkpoint(rest.select("kind", "parent", "child"))
    out = spark.createDataFrame([], schema)
    for x in found:
        out = out.unionByName(x)
    return out


def _spread(edges: DataFrame, value: DataFrame, frm: str, to: str) -> DataFrame:
    """``kind, node, c`` with the greatest ``c`` that reaches the node, to the fixed point; each round only those that
    moved pass theirs on."""
    value = checkpoint(value.withColumn("_moved", F.col("c").isNotNull()))
    while True:
        moved = value.filter("_moved").select("kind", F.col("node").alias(frm), "c")
        came = edges.join(moved, ["kind", frm]).groupBy("kind", F.col(to).alias("node")).agg(F.max("c").alias("_came"))
        nxt = value.drop("_moved").join(came, ["kind", "node"], "left")
        more = F.col("_came").isNotNull() & (F.col("c").isNull() | (F.col("_came") > F.col("c")))
        nxt = checkpoint(nxt.select("kind", "node", F.when(more, F.col("_came")).otherwise(F.col("c")).alias("c"), more.alias("_moved")))
        drop_checkpoint(value)
        value = nxt
        if value.filter("_moved").isEmpty():
            return value.drop("_moved")


def ancestor_pairs(tree: DataFrame) -> DataFrame:
    """``kind, ancestor_id, node_id, distance`` along the one path kept for each node; ``descendants`` takes all links."""
    pairs = tree.select("kind", "node_id", "depth", F.posexplode("path").alias("_at", "ancestor_id"))
    return pairs.filter(F.col("_at") < F.col("depth")).select("kind", "ancestor_id", "node_id", (F.col("depth") - F.col("_at")).alias("distance"))


def descendants(edges: DataFrame) -> DataFrame:
    """``kind, ancestor_id, node_id, distance``: all descendants of every node over all (distinct) links, with the least
    number of links between; a node is not its own descendant.

    The frontier of pairs is joined with the links level by level until it is empty. A pair can be met twice only on ways
    that pass a node with several parents, so only pairs found by such a way are compared with those met before.
    """
    spark = edges.sparkSession
    base = checkpoint(edges.filter("parent <> child"))
    both = base.select("kind", F.col("parent").alias("name")).union(base.select("kind", F.col("child").alias("name")))
    names = checkpoint(both.distinct().withColumn("no", F.monotonically_increasing_id()))
    merges = base.groupBy("kind", "child").agg((F.count(F.lit(1)) > 1).alias("_merges"))
    numbered = base.join(merges, ["kind", "child"]).join(names.select("kind", F.col("name").alias("child"), F.col("no").alias("_to")), ["kind", "child"])
    step = checkpoint(numbered.join(names.select("kind", F.col("name").alias("parent"), F.col("no").alias("_from")), ["kind", "parent"]).select("_from", "_to", "_merges"))
    drop_checkpoint(base)
    # One folder for all levels, read as one table, so that plans stay small however deep the hierarchy is.
    folder, cols = shared_dir(spark), "a long, n long, m boolean"
    new, distance = step.select(F.col("_from").alias("a"), F.col("_to").alias("n"), F.col("_merges").alias("m")), 0
    while True:
        distance += 1
        new.write.parquet(f"{folder}/distance={distance}")
        level = spark.read.schema(cols).parquet(f"{folder}/distance={distance}")
        out = spark.read.schema(f"{cols}, distance int").parquet(folder)
        if level.isEmpty():
            break
        on = level.join(step.withColumnRenamed("_from", "n"), "n").filter("_to <> a").select("a", F.col("_to").alias("n"), (F.col("m") | F.col("_merges")).alias("m"))
        new = on.filter("NOT m").unionByName(on.filter("m").distinct().join(out.filter("m").select("a", "n"), ["a", "n"], "left_anti"))
    named = out.join(names.select("kind", F.col("name").alias("ancestor_id"), F.col("no").alias("a")), "a")
    return named.join(names.select(F.col("name").alias("node_id"), F.col("no").alias("n")), "n").select("kind", "ancestor_id", "node_id", "distance")
