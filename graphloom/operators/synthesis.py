"""Calls that only happen at run time, found from text and structure: callbacks, events, rendering; and enclosing
functions by line."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import Graph

WEB = ("javascript", "typescript", "jsx", "tsx")
MAX_SITES, MAX_PER_EVENT, MAX_TAGS = 40, 6, 30
#: Lines of one bin of the interval join of lines and functions.
BIN = 64


def enclosing_function(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """``points`` (``file_path, line``) with ``enclosing_id``: the function, method or component of the smallest span
    around the line. Interval join by bins of lines; only spans that touch a bin meet its points."""
    f = nodes.filter(F.col("kind").isin("function", "method", "component") & F.col("start_line").isNotNull() & (F.col("end_line") >= F.col("start_line")))
    f = f.select(F.col("file_path"), F.col("id").alias("enclosing_id"), F.col("start_line").alias("s"), F.col("end_line").alias("e"), F.explode(F.sequence(F.floor(F.col("start_line") / BIN), F.floor(F.col("end_line") / BIN))).alias("_bin"))
    p = points.withColumn("_bin", F.floor(F.col("line") / BIN))
    hit = p.join(f, ["file_path", "_bin"]).filter("line >= s AND line <= e")
    best = F.min(F.struct((F.col("e") - F.col("s")).alias("span"), (-F.col("s")).alias("neg"), "enclosing_id")).alias("b")
    return hit.groupBy(*points.columns).agg(best).select(*points.columns, F.col("b.enclosing_id").alias("enclosing_id"))


def _lines(texts: DataFrame) -> DataFrame:
    """``file_path, line, text`` of the web languages' files."""
    own = texts.filter(F.col("language").isin(*WEB))
    return own.select("file_path", F.posexplode(F.split("text", "\r?\n")).alias("_i", "text")).select("file_path", (F.col("_i") + 1).alias("line"), "text")


def _unique(nodes: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Names that one node of the kinds has."""
    return nodes.filter(F.col("kind").isin(*kinds)).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("target")).filter("n = 1").drop("n")


def event_calls(graph: Graph, texts: DataFrame) -> DataFrame:
    """From the function that emits an event to its named handlers; events with more than ``MAX_PER_EVENT`` emitters or
    handlers are left out."""
    lines = _lines(texts).filter(F.col("text").contains("emit(") | F.col("text").contains(".on(") | F.col("text").contains("addListener(") | F.col("text").contains(".once("))
    emit = lines.withColumn("event", F.regexp_extract("text", r"\bemit\(\s*['\"`]([^'\"`]+)['\"`]", 1)).filter("event != ''")
    on = lines.withColumn("event", F.regexp_extract("text", r"\.(?:on|once|addListener)\(\s*['\"`]([^'\"`]+)['\"`]\s*,\s*(?:this\.)?([A-Za-z_$][\w$]*)\s*[,)]", 1)).withColumn("name", F.regexp_extract("text", r"\.(?:on|once|addListener)\(\s*['\"`]([^'\"`]+)['\"`]\s*,\s*(?:this\.)?([A-Za-z_$][\w$]*)\s*[,)]", 2)).filter("event != ''")
    sources = enclosing_function(emit.select("file_path", "line", "event"), graph.nodes).select("event", F.col("enclosing_id").alias("source")).distinct()
    targets = on.join(_unique(graph.nodes, ("function", "method")), "name").select("event", "target", F.concat_ws(":", "file_path", "line").alias("registered")).groupBy("event", "target").agg(F.min("registered").alias("registered"))
    few = lambda df: df.join(df.groupBy("event").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= MAX_PER_EVENT), "event", "left_semi")
    out = few(sources).join(few(targets), "event").filter("source != target")
    return _edges(out, "event-emitter", 0.6, event=F.col("event"), registeredAt=F.col("registered"))


def render_calls(graph: Graph, texts: DataFrame) -> DataFrame:
    """From methods that set state to their class's ``render``; at most ``MAX_SITES`` a class, in order."""
    sets = _lines(texts).filter(F.col("text").contains("this.setState("))
    who = enclosing_function(sets.select("file_path", "line"), graph.nodes).select(F.col("enclosing_id").alias("source")).distinct()
    inside = graph.edges.filter("kind = 'contains'").select(F.col("source").alias("cls"), F.col("target").alias("id"))
    n = graph.nodes.select("id", "name", "start_line")
    member = inside.join(n, "id")
    render = member.filter("name = 'render'").select("cls", F.col("id").alias("target"))
    hit = member.join(who.withColumnRenamed("source", "id"), "id", "left_semi").join(render, "cls").filter("id != target")
    r = F.row_number().over(W.partitionBy("cls").orderBy("start_line", "name", "id"))
    return _edges(hit.withColumn("r", r).filter(F.col("r") <= MAX_SITES).withColumnRenamed("id", "source"), "react-render", 0.8)


def tag_calls(graph: Graph, texts: DataFrame) -> DataFrame:
    """From a function to the components whose tags it writes; the first ``MAX_TAGS`` names of a body."""
    tags = _lines(texts).filter(F.col("text").rlike(r"<[A-Z]\w*[\s/>]"))
    at = enclosing_function(tags.select("file_path", "line", "text"), graph.nodes)
    names = at.select(F.col("enclosing_id").alias("source"), F.explode(F.regexp_extract_all("text", F.lit(r"<([A-Z]\w*)[\s/>]"), 1)).alias("name")).distinct()
    r = F.row_number().over(W.partitionBy("source").orderBy("name"))
    hit = names.withColumn("r", r).filter(F.col("r") <= MAX_TAGS).join(_unique(graph.nodes, ("component", "function", "class")), "name").filter("source != target")
    return _edges(hit, "jsx-render", 0.8)


def callback_calls(graph: Graph, texts: DataFrame) -> DataFrame:
    """From a class's dispatcher of a field of callbacks to the functions that are registered for it elsewhere."""
    lines = _lines(texts)
    field = r"this\.(\w+)"
    add = lines.withColumn("field", F.regexp_extract("text", field + r"\.(?:push|add|set)\(", 1)).filter("field != ''")
    run = lines.withColumn("field", F.regexp_extract("text", r"(?:for\s*\(.*\bof\s+" + field + r"\b|" + field + r"\.forEach\()", 0)).withColumn("field", F.regexp_extract("field", field, 1)).filter("field != ''")
    registrar = enclosing_function(add.select("file_path", "line", "field"), graph.nodes).select("file_path", "field", F.col("enclosing_id").alias("registrar")).distinct()
    dispatcher = enclosing_function(run.select("file_path", "line", "field"), graph.nodes).select("file_path", "field", F.col("enclosing_id").alias("source")).distinct()
    pair = registrar.join(dispatcher, ["file_path", "field"]).filter("registrar != source")
    names = graph.nodes.select(F.col("id").alias("registrar"), F.col("name").alias("method"))
    calls = graph.edges.filter("kind = 'calls'").select(F.col("target").alias("registrar"), F.col("source").alias("site"), "line")
    where = graph.nodes.select(F.col("id").alias("site"), F.col("file_path").alias("site_file"))
    sites = pair.join(names, "registrar").join(calls, "registrar").join(where, "site").filter("line IS NOT NULL")
    text = lines.select(F.col("file_path").alias("site_file"), "line", "text")
    arg = F.regexp_extract("text", r"\.(\w+)\(\s*(?:this\.)?([A-Za-z_$][\w$]*)\s*[,)]", 2)
    hit = sites.join(text, ["site_file", "line"]).filter(F.expr("contains(text, concat('.', method, '('))")).withColumn("name", arg).filter("name != ''").join(_unique(graph.nodes, ("function", "method")), "name").filter("source != target")
    r = F.row_number().over(W.partitionBy("source", "field").orderBy("site_file", "line", "target"))
    return _edges(hit.withColumn("r", r).filter(F.col("r") <= MAX_SITES), "callback", 0.7, field=F.col("field"), registeredAt=F.concat_ws(":", "site_file", "line"))


def _edges(pairs: DataFrame, by: str, confidence: float, **meta) -> DataFrame:
    m = F.to_json(F.struct(F.lit(confidence).alias("confidence"), F.lit(by).alias("synthesizedBy"), *[v.alias(k) for k, v in meta.items()]))
    return pairs.select("source", "target", F.lit("calls").alias("kind"), m.alias("metadata"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("column_no"), F.lit("heuristic").alias("provenance"), F.lit(by).alias("_by"))


PASSES: list[Callable[[Graph, DataFrame], DataFrame]] = [callback_calls, event_calls, render_calls, tag_calls]


def register_pass(p: Callable[[Graph, DataFrame], DataFrame]) -> None:
    PASSES.append(p)


def synthesize(graph: Graph, texts: DataFrame) -> DataFrame:
    """Edges of all passes; one for each source and target, from the first pass that found it.

    ``texts`` has ``file_path, language, text``."""
    every = None
    for i, p in enumerate(PASSES):
        part = p(graph, texts).withColumn("_pass", F.lit(i))
        every = part if every is None else every.unionByName(part)
    r = F.row_number().over(W.partitionBy("source", "target").orderBy("_pass", "metadata"))
    return every.withColumn("_r", r).filter("_r = 1").drop("_r", "_pass", "_by")
