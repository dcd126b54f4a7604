"""What belongs to a question: terms, candidates from several channels, merging, connectivity, roots, and a rendered
context. Each pass is a step from a small set of scored candidates to the next; statistics come from all nodes.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import CALLABLE, DEFINITIONS
from ..session import checkpoint
from . import search, traverse
from .analytics import is_noise_path
from .store import Graph

STOPWORDS = frozenset("a an and are as at be by can do does for from has have how i if in into is it its me my no not of on or our so that the their then there these they this to use used using was we what when where which who why will with you your show find explain tell about get works work happen happens".split())
SEARCH_LIMIT, MIN_SCORE = 60, 1.0
SEEDS, HUB_DEGREE, NEIGHBOURS, ADMIT = 20, 24, 60, 0.35
BIG_REPOSITORY = 3000


def query_terms(query: str) -> list[str]:
    """Identifiers first as they stand, then plain words; each once, without words that say nothing."""
    out: dict[str, None] = {}
    for pattern in (r"`([^`\s]+)`", r"\b([A-Za-z_]\w*(?:(?:::|\.)[A-Za-z_]\w*)+)\b", r"\b([a-z]+(?:[A-Z][a-z0-9]*)+)\b", r"\b([A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+)\b", r"\b([a-z0-9]+(?:_[a-z0-9]+)+)\b", r"\b([A-Za-z]\w{2,})\b"):
        for m in re.findall(pattern, query):
            if m.lower() not in STOPWORDS:
                out.setdefault(m)
    return list(out)


def term_groups(terms: list[str]) -> list[list[str]]:
    """Terms of which one contains the other are one group."""
    groups: list[list[str]] = []
    for t in sorted(terms, key=lambda t: (-len(t), t)):
        for g in groups:
            if any(t.lower() in x.lower() for x in g):
                g.append(t)
                break
        else:
            groups.append([t])
    return groups


def corpus_terms(nodes: DataFrame, terms: list[str], least_names: int = 3, per_term: int = 2) -> DataFrame:
    """``term, derived, names``: parts of long terms (five letters or more) with which three or more names begin."""
    parts = sorted({(t, t[a:b]) for t in {x.lower() for x in terms} if len(t) >= 7 for a in range(len(t)) for b in range(a + 5, len(t) + 1) if len(t) - (b - a) >= 2})
    spark = nodes.sparkSession
    if not parts:
        return spark.createDataFrame([], "term string, derived string, names long")
    want = F.broadcast(spark.createDataFrame(parts, "term string, derived string").withColumn("head", F.substring("derived", 1, 5)))  # from one question
    names = nodes.filter(~F.coalesce(is_noise_path(F.col("file_path")), F.lit(False))).select(F.lower("name").alias("name")).distinct().withColumn("head", F.substring("name", 1, 5))
    hit = names.join(want, "head").filter(F.expr("startswith(name, derived)")).groupBy("term", "derived").agg(F.count(F.lit(1)).alias("names")).filter(F.col("names") >= least_names)
    r = F.row_number().over(W.partitionBy("term").orderBy(F.desc("names"), F.desc(F.length("derived")), "derived"))
    return hit.withColumn("r", r).filter(F.col("r") <= per_term).drop("r")


def _brevity(name: str = "name"):
    return F.greatest(F.lit(0.0), 10 - F.octet_length(name) / 4)


def candidates(graph: Graph, query: str, semantic: DataFrame | None = None, limit: int = SEARCH_LIMIT) -> DataFrame:
    """``id, channel, score``: exact names (with a bonus for names that share a file), definitions with a term as
    prefix, text search of each term, substring names with a bonus for several terms, and vectors."""
    nodes, spark = graph.nodes, graph.nodes.sparkSession
    terms = query_terms(query)
    if not terms:
        return spark.createDataFrame([], "id string, channel string, score double")
    low = [t.lower() for t in terms]
    own = nodes.filter(~F.col("kind").isin("import", "file")).select("id", "name", "kind", "qualified_name", "file_path", F.lower("name").alias("low"))
    exact = own.filter(F.col("low").isin(*low))
    together = exact.groupBy("file_path").agg(F.countDistinct("low").alias("terms"))
    out = exact.join(together, "file_path").select("id", F.lit("exact").alias("channel"), (F.lit(100.0) + 20 * (F.col("terms") - 1)).alias("score"))
    starts = F.lit(False)
    for t in low:
        starts = starts | F.col("low").startswith(t)
    prefix = own.filter(F.col("kind").isin(*DEFINITIONS) & starts).select("id", F.lit("prefix").alias("channel"), (F.lit(15.0) + _brevity()).alias("score"), "name").orderBy(F.desc("score"), "id").limit(limit).drop("name")
    out = out.unionByName(prefix)
    index, lengths = search.postings(nodes), search.field_lengths(nodes)
    hits = None
    for t in terms[:12]:
        h = search.search_fts(nodes, t, limit, match_all=True, index=index, lengths=lengths).select("id", F.col("score"), F.lit(t).alias("term"))
        hits = h if hits is None else hits.unionByName(h)
    top = W.partitionBy("term")
    text = hits.withColumn("s", 25 * F.col("score") / F.greatest(F.max("score").over(top), F.lit(1e-9))).groupBy("id").agg((F.max("s") + 5 * (F.count(F.lit(1)) - 1)).alias("score"))
    out = out.unionByName(text.select("id", F.lit("text").alias("channel"), "score"))
    count = sum((F.col("low").contains(t).cast("int") for t in low), F.lit(0))
    best = F.greatest(*[F.when(F.col("low") == t, 1.0).when(F.col("low").startswith(t), 0.8).when(F.col("low").contains(t), 0.7).otherwise(0.0) for t in low], F.lit(0.0))
    like = own.withColumn("hits", count).filter("hits > 0").withColumn("score", (8 + _brevity()) * best * (1 + F.col("hits")) + 30 * (F.col("hits") - 1)).orderBy(F.desc("score"), "id").limit(limit)
    out = out.unionByName(like.select("id", F.lit("like").alias("channel"), "score"))
    if semantic is not None:
        out = out.unionByName(semantic.select("id", F.lit("vector").alias("channel"), (20 * F.col("score")).alias("score")))
    return out


def relevant(graph: Graph, query: str, semantic: DataFrame | None = None, roots: int = 8, limit: int = SEARCH_LIMIT) -> DataFrame:
    """``id, name, kind, file_path, score``: candidates merged, tests damped, several terms raised, connected ones
    raised, one root for each name and file."""
    nodes = graph.nodes
    terms = query_terms(query)
    groups = term_groups(terms)
    merged = candidates(graph, query, semantic, limit).groupBy("id", "channel").agg(F.max("score").alias("score")).groupBy("id").agg(F.sum("score").alias("score"), F.max((F.col("channel") == "exact").cast("int")).alias("exact"))
    c = checkpoint(merged.join(nodes.select("id", "name", "kind", "file_path", "qualified_name", "docstring"), "id"))
    text = F.lower(F.concat_ws(" ", "name", "qualified_name", "docstring", "file_path"))
    met = sum((F.greatest(*[text.contains(t.lower()).cast("int") for t in g], F.lit(0)) for g in groups), F.lit(0))
    noise = F.coalesce(is_noise_path(F.col("file_path")), F.lit(False)) & F.lit("test" not in query.lower())
    c = c.withColumn("terms", met).withColumn("score", F.col("score") * F.when(noise, 0.3).otherwise(1.0) * F.when(F.col("terms") >= 2, 1 + 0.5 * (F.col("terms") - 1)).when((F.col("exact") == 1) | F.lit(len(groups) < 2), 1.0).otherwise(0.6))
    seeds = checkpoint(c.orderBy(F.desc("score"), "id").limit(SEEDS))
    linked = connectivity(graph, seeds.select("id"), groups)
    out = c.join(linked, "id", "full").select("id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("gain", F.lit(0.0)).alias("gain"))
    out = out.withColumn("score", F.col("score") + 30 * F.col("gain")).join(nodes.select("id", "name", "kind", "file_path"), "id")
    out = out.filter((F.col("score") >= MIN_SCORE) & (F.col("gain") + F.col("score") > 0))
    r = F.row_number().over(W.partitionBy(F.lower("name"), "file_path").orderBy(F.desc("score"), "id"))
    return out.withColumn("r", r).filter("r = 1").orderBy(F.desc(F.round("score", 6)), "id").limit(roots).select("id", "name", "kind", "file_path", F.round("score", 6).alias("score"))


def connectivity(graph: Graph, seeds: DataFrame, groups: list[list[str]]) -> DataFrame:
    """``id, gain``: callables within two hops of the seeds that many terms' seeds reach, less for well-connected ones;
    paths do not go on through hubs."""
    spark = seeds.sparkSession
    e = graph.edges.filter("kind != 'contains' AND source != target").select("source", "target")
    both = e.union(e.select("target", "source")).distinct()
    deg = both.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    first = seeds.select(F.col("id").alias("source"), F.col("id").alias("seed")).join(both, "source").select(F.col("target").alias("id"), "seed").distinct()
    near = W.partitionBy("seed").orderBy("id")
    first = checkpoint(first.withColumn("r", F.row_number().over(near)).filter(F.col("r") <= NEIGHBOURS).drop("r"))
    thin = first.join(deg.filter(F.col("degree") <= HUB_DEGREE), "id").select(F.col("id").alias("source"), "seed")
    second = thin.join(both, "source").select(F.col("target").alias("id"), "seed").distinct()
    reach = first.union(second).distinct().groupBy("id").agg(F.countDistinct("seed").alias("n"))
    total = max(1, seeds.count())
    g = reach.join(deg, "id").withColumn("g", (F.col("n") / total) / F.log(math.e + F.col("degree")))
    top = g.agg(F.max("g").alias("top"))
    ok = graph.nodes.filter(F.col("kind").isin(*CALLABLE)).select("id")
    return g.crossJoin(F.broadcast(top)).withColumn("gain", F.col("g") / F.col("top")).filter(F.col("gain") >= ADMIT).join(ok, "id", "left_semi").select("id", "gain") if groups else spark.createDataFrame([], "id string, gain double")  # one row


BUDGETS = ((150, 40), (500, 30), (5000, 20), (15000, 14))


def budget(files: int) -> int:
    """How many symbols a context shows, by the number of files."""
    return next((n for limit, n in BUDGETS if files < limit), 10)


def explore(graph: Graph, query: str, texts: DataFrame | None = None, max_lines: int = 40) -> str:
    """The context of a question as Markdown: symbols, flow, boundaries, relations, impact, sources."""
    files = graph.nodes.filter("kind = 'file'").count()
    roots = relevant(graph, query, roots=budget(files)).collect()
    if not roots:
        return f"# {query}\n\nNothing was found."
    ids = [r["id"] for r in roots]
    lines = [f"# {query}", "", "## Symbols", *[f"- {r['kind']} `{r['name']}` in {r['file_path']} ({r['score']:.1f})" for r in roots]]
    if roots[0]["score"] < 20:
        lines += ["", "_The match is weak._"]
    flow = traverse.flows(graph, ids[:8], [t.lower() for t in query_terms(query)], 5, 300).limit(1).collect()
    if flow:
        names = {r["id"]: r["name"] for r in graph.nodes.filter(F.col("id").isin(*flow[0]["path"])).select("id", "name").collect()}
        lines += ["", "## Flow", " → ".join(names.get(i, i) for i in flow[0]["path"])]
    edge = traverse.boundaries(graph).filter(F.col("id").isin(*ids)).orderBy("id").collect()
    if edge:
        lines += ["", "## Boundaries", *[f"- {r['boundary']}: {r['id']} ({r['n']})" for r in edge]]
    pick = graph.nodes.filter(F.col("id").isin(*ids)).select("id")
    rel = graph.edges.join(pick.withColumnRenamed("id", "source"), "source", "left_semi").join(pick.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "kind", "target").distinct().orderBy("source", "kind", "target").limit(40).collect()
    if rel:
        lines += ["", "## Relations", *[f"- {r['source']} {r['kind']} {r['target']}" for r in rel]]
    hit = traverse.callers(graph, pick, 1).groupBy("start_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "start_id").limit(10).collect()
    lines += ["", "## Callers", *[f"- {r['start_id']}: {r['n']}" for r in hit]]
    if texts is not None:
        where = graph.nodes.filter(F.col("id").isin(*ids[:8])).select("id", F.col("file_path").alias("path"), "start_line", "end_line")
        code = texts.select("path", "text").join(F.broadcast(where), "path").select("id", "path", "start_line", code_slice(F.col("text"), F.col("start_line"), F.least(F.col("end_line"), F.col("start_line") + max_lines)).alias("code"))
        lines += ["", "## Sources"]
        for r in code.orderBy("path", "start_line").collect():
            lines += [f"### {r['path']}:{r['start_line']}", "```", r["code"], "```"]
    return "\n".join(lines)


def code_slice(text, first, last, number: bool = True):
    """Lines ``first`` to ``last`` of a text, with their numbers."""
    rows = F.slice(F.split(text, r"\r?\n"), F.greatest(first, F.lit(1)), F.greatest(F.lit(1), last - first + 1))
    if not number:
        return F.array_join(rows, "\n")
    return F.array_join(F.transform(rows, lambda x, i: F.concat((i + F.greatest(first, F.lit(1))).cast("string"), F.lit("\t"), x)), "\n")


def node_view(graph: Graph, node_id: str, texts: DataFrame) -> dict:
    """A symbol with its code and its direct callers and callees over calls and references."""
    n = graph.nodes.filter(F.col("id") == node_id).limit(1).collect()
    if not n:
        return {}
    n = n[0]
    code = texts.filter(F.col("path") == n["file_path"]).select(code_slice(F.col("text"), F.lit(n["start_line"] or 1), F.lit(n["end_line"] or 1)).alias("c")).limit(1).collect()
    e = graph.edges.filter(F.col("kind").isin("calls", "references"))
    ends = lambda here, there: sorted(r[0] for r in e.filter(F.col(here) == node_id).select(there).distinct().limit(1000).collect())
    return {"node": n.asDict(), "code": code[0]["c"] if code else None, "callers": ends("target", "source"), "callees": ends("source", "target")}


class Memory:
    """What was asked before: at most 500 entries of at most 300 characters, as JSON lines in the store's folder."""

    def __init__(self, spark, path: str, cap: int = 500):
        self.spark, self.path, self.cap = spark, path, cap

    def _rows(self) -> DataFrame:
        try:
            return self.spark.read.schema("ts long, query string, headline string").json(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], "ts long, query string, headline string")

    def remember(self, ts: int, query: str, headline: str) -> None:
        rows = self._rows().orderBy(F.desc("ts")).limit(self.cap - 1).collect()
        new = [(ts, query[:300], headline[:300]), *[(r["ts"], r["query"], r["headline"]) for r in rows]]
        self.spark.createDataFrame(new, "ts long, query string, headline string").coalesce(1).write.mode("overwrite").json(self.path)

    def recall(self, query: str, top: int = 5) -> list[tuple[int, str, str]]:
        words = sorted({w.lower() for w in re.findall(r"\w{3,}", query)} - STOPWORDS)
        if not words:
            return []
        n = F.size(F.array_intersect(F.array(*map(F.lit, words)), F.transform(F.regexp_extract_all(F.concat_ws(" ", "query", "headline"), F.lit(r"(\w{3,})"), 1), lambda w: F.lower(w))))
        return [(r["ts"], r["query"], r["headline"]) for r in self._rows().withColumn("n", n).filter("n > 0").orderBy(F.desc("n"), F.desc("ts")).limit(top).collect()]


def group_hits(rows: Iterable[tuple[str, str]]) -> dict[str, list[str]]:
    """Ids by definition (file and qualified name), in the order in which they came."""
    out: dict[str, list[str]] = defaultdict(list)
    for definition, i in rows:
        out[definition].append(i)
    return dict(out)
