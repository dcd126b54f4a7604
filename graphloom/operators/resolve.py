"""Binding references to symbols: every strategy gives candidates, the ladder and the confidence decide.

All strategies are joins of the reference table with the symbol table. Names with more than ``CEILING`` symbols are not
joined at all for the exact match (a guard of the semantics and against hot names), others are scored. Among the
strategies by name the first that finds something counts: path, qualified name, method, exact name, fuzzy name. Its
candidate competes by confidence with those of imports and of registered strategies; then the order of strategies and
the candidate's own order decide. Candidates are ordered by file, line and id, which stands for the order of insertion.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import basename, directory, family, last_segment, shared_prefix
from ..schema import CLASS_LIKE
from ..session import checkpoint
from .store import REF_KEY, Graph

CEILING = 500
#: Names every program of a language knows; independent lists, to be extended by ``extra_builtins``.
BUILTINS = {
    "python": "print len range str int float list dict set tuple isinstance super open enumerate zip map filter sorted sum min max abs any all getattr setattr hasattr type repr id iter next".split(),
    "javascript": "console JSON Math Object Array Promise Map Set Symbol parseInt parseFloat setTimeout setInterval clearTimeout require Number String Boolean Date Error RegExp".split(),
    "go": "append cap close complex copy delete imag len make new panic print println real recover error string int bool byte rune".split(),
    "java": "System String Integer Long Double Boolean Object Math List Map Set Arrays Collections Optional Exception".split(),
    "rust": "println print format vec panic assert Some None Ok Err Box Vec String Option Result clone unwrap into".split(),
}
BUILTINS["typescript"] = BUILTINS["javascript"]


def with_ref_id(refs: DataFrame) -> DataFrame:
    """References with ``ref_id``: one for each distinct row, so that copies are resolved once and joined back."""
    cols = [*REF_KEY, "line", "column_no", "file_path", "language"]
    return refs.select(*cols).distinct().withColumn("ref_id", F.xxhash64(*cols))


def symbols(nodes: DataFrame) -> DataFrame:
    """What candidates are drawn from: all symbols but imports, files and their like, with their order."""
    own = nodes.filter(~F.col("kind").isin("import", "file", "document", "section"))
    return own.select(
        F.col("id").alias("target"), F.col("kind").alias("t_kind"), F.col("name").alias("t_name"), F.col("qualified_name").alias("t_qualified"), F.col("file_path").alias("t_file"), F.col("language").alias("t_language"),
        F.coalesce("start_line", F.lit(0)).alias("t_line"), F.coalesce("is_exported", F.lit(False)).alias("t_exported"),
    )


def _order() -> list:
    return ["t_file", "t_line", "target"]


def is_builtin(extra: dict[str, list[str]] | None = None) -> Column:
    known = {k: [*v, *(extra or {}).get(k, [])] for k, v in BUILTINS.items()}
    hit = F.lit(False)
    for lang, names in known.items():
        hit = hit | ((F.col("language") == lang) & F.regexp_extract("reference_name", r"^\w+", 0).isin(*names))
    return hit


def prefilter(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """References of which any spelling (whole, last segment, receiver, basename) is a known name."""
    names = nodes.select(F.col("name").alias("n")).distinct()
    spelled = F.array_distinct(F.array(F.col("reference_name"), last_segment(F.col("reference_name")), F.element_at(F.split("reference_name", r"\.|::"), 1), basename(F.col("reference_name"))))
    hit = refs.withColumn("n", F.explode(spelled)).join(names, "n", "left_semi").select("ref_id").distinct()
    return refs.join(hit, "ref_id", "left_semi")


def same_family() -> Column:
    a, b = family(F.col("language")), family(F.col("t_language"))
    return (F.col("language") == F.col("t_language")) | (a == b)


def language_gate() -> Column:
    """References and function values stay in their family; imports do not cross known families."""
    a, b = family(F.col("language")), family(F.col("t_language"))
    strict = F.coalesce(same_family(), F.lit(False))
    crossing = a.isNotNull() & b.isNotNull() & (a != b)
    return F.when(F.col("reference_kind").isin("references", "function_ref"), strict).when(F.col("reference_kind") == "imports", ~F.coalesce(crossing, F.lit(False))).otherwise(F.lit(True))


def score() -> Column:
    """How well a candidate of the right name fits the place of the reference."""
    same_file = F.col("file_path") == F.col("t_file")
    s = F.when(same_file, 100).otherwise(0)
    s = s + F.least(F.lit(80), 15 * shared_prefix(F.col("file_path"), F.col("t_file")))
    s = s + F.when(F.col("language") == F.col("t_language"), 50).otherwise(-80)
    s = s + F.when((F.col("reference_kind") == "calls") & F.col("t_kind").isin("function", "method"), 25).otherwise(0)
    s = s + F.when((F.col("reference_kind") == "instantiates") & F.col("t_kind").isin(*CLASS_LIKE), 25).otherwise(0)
    s = s + F.when((F.col("reference_kind") == "decorates") & F.col("t_kind").isin("function", "method"), 25).when((F.col("reference_kind") == "decorates") & F.col("t_kind").isin(*CLASS_LIKE), 15).otherwise(0)
    s = s + F.when(F.col("t_exported"), 10).otherwise(0)
    near = F.greatest(F.lit(0), 20 - F.floor(F.abs(F.coalesce("line", F.lit(0)) - F.col("t_line")) / 10))
    return (s + F.when(same_file & F.col("line").isNotNull(), near).otherwise(0)).cast("int")


def _candidate(df: DataFrame, confidence: Column, by: str, ladder: int) -> DataFrame:
    return df.select("ref_id", "target", "t_kind", "t_file", "t_line", confidence.cast("double").alias("confidence"), F.lit(by).alias("resolved_by"), F.lit(ladder).alias("ladder"))


def by_file_path(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """A path: exact .95, as the end of one .85 (the closest), a lone basename .7."""
    files = nodes.filter(F.col("kind").isin("file", "document")).select(F.col("id").alias("target"), F.col("kind").alias("t_kind"), F.col("file_path").alias("t_file"), F.lit(0).alias("t_line"), basename(F.col("file_path")).alias("b"))
    like = refs.filter(F.col("reference_name").contains("/") | F.col("reference_name").rlike(r"^[^./\s]+\.[A-Za-z]{1,4}$")).withColumn("b", basename(F.col("reference_name")))
    hit = like.join(files, "b")
    n = F.count(F.lit(1)).over(W.partitionBy("ref_id"))
    c = F.when(F.col("t_file") == F.col("reference_name"), 0.95).when(F.col("t_file").endswith(F.concat(F.lit("/"), F.regexp_replace("reference_name", r"^(?:\.\.?/)+", ""))), 0.85).when(n == 1, 0.7)
    hit = hit.withColumn("c", c).filter("c IS NOT NULL")
    r = F.row_number().over(W.partitionBy("ref_id").orderBy(F.desc("c"), F.desc(shared_prefix(F.col("file_path"), F.col("t_file"))), "t_file"))
    return _candidate(hit.withColumn("r", r).filter("r = 1"), F.col("c"), "file-path", 0)


def by_qualified_name(refs: DataFrame, syms: DataFrame) -> DataFrame:
    """A qualified name: one symbol .95, several then the one of the same file .95, else the end of one .85."""
    q = refs.filter(F.col("reference_name").rlike(r"\.|::")).withColumn("q", F.regexp_replace("reference_name", r"\.", "::"))
    tail = q.withColumn("t_name", last_segment(F.col("reference_name"))).join(syms, "t_name").filter("target != from_node_id").filter(language_gate())
    exact = tail.filter((F.col("t_qualified") == F.col("q"))).withColumn("same", F.col("file_path") == F.col("t_file"))
    n = F.count(F.lit(1)).over(W.partitionBy("ref_id"))
    r = F.row_number().over(W.partitionBy("ref_id").orderBy(F.desc("same"), *_order()))
    exact = exact.withColumn("n", n).withColumn("r", r).filter("r = 1 AND (n = 1 OR same)")
    ends = tail.filter(F.col("t_qualified").endswith(F.concat(F.lit("::"), F.col("q"))))
    r = F.row_number().over(W.partitionBy("ref_id").orderBy(F.desc(F.col("file_path") == F.col("t_file")), F.desc(shared_prefix(F.col("file_path"), F.col("t_file"))), *_order()))
    ends = ends.withColumn("r", r).filter("r = 1")
    return _candidate(exact, F.lit(0.95), "qualified-name", 1).unionByName(_candidate(ends, F.lit(0.85), "qualified-name", 1))


def by_method(refs: DataFrame, syms: DataFrame) -> DataFrame:
    """``receiver.member``: a class of the receiver's name .85, of its capitalised name .8, else the only method of the
    name .7."""
    m = refs.withColumn("recv", F.regexp_extract("reference_name", r"^(\w+)(?:\.|::)\w+$", 1)).filter("recv != ''").withColumn("t_name", last_segment(F.col("reference_name")))
    methods = syms.filter(F.col("t_kind") == "method").withColumn("owner", F.regexp_extract("t_qualified", r"(\w+)::\w+$", 1))
    hit = m.join(methods, "t_name").filter("target != from_node_id").filter(F.coalesce(same_family(), F.lit(False)))
    n = F.count(F.lit(1)).over(W.partitionBy("ref_id"))
    c = F.when(F.col("owner") == F.col("recv"), 0.85).when(F.col("owner") == F.initcap("recv"), 0.8).when(F.lower("owner") == F.lower("recv"), 0.8).when(n == 1, 0.7)
    hit = hit.withColumn("c", c).filter("c IS NOT NULL")
    r = F.row_number().over(W.partitionBy("ref_id").orderBy(F.desc("c"), F.desc(F.col("file_path") == F.col("t_file")), *_order()))
    return _candidate(hit.withColumn("r", r).filter("r = 1"), F.col("c"), "instance-method", 2)


def by_exact_name(refs: DataFrame, syms: DataFrame, ceiling: int = CEILING) -> DataFrame:
    """The plain name: one symbol .9 (.5 in another language), several then the best by ``score`` with .7 or .4."""
    counts = syms.groupBy("t_name").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") <= ceiling)
    open_names = syms.join(counts, "t_name")
    hit = refs.withColumn("t_name", last_segment(F.col("reference_name"))).filter("t_name = reference_name OR reference_kind = 'calls'").join(open_names, "t_name").filter("target != from_node_id").filter(language_gate())
    same = F.col("language") == F.col("t_language")
    hit = hit.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("ref_id"))).withColumn("any_same", F.max(F.coalesce(same, F.lit(False))).over(W.partitionBy("ref_id")))
    hit = hit.filter(~F.col("any_same") | F.coalesce(same, F.lit(False))).withColumn("s", score())
    r = F.row_number().over(W.partitionBy("ref_id").orderBy(F.desc("s"), *_order()))
    best = hit.withColumn("r", r).filter("r = 1")
    near = F.least(F.lit(80), 15 * shared_prefix(F.col("file_path"), F.col("t_file"))) + F.when(F.col("file_path") == F.col("t_file"), 100).otherwise(0)
    c = F.when(F.col("n") == 1, F.when(F.coalesce(same, F.lit(False)), 0.9).otherwise(0.5)).when(near >= 30, 0.7).otherwise(0.4)
    return _candidate(best, c, "exact-match", 3)


def by_fuzzy_name(refs: DataFrame, syms: DataFrame) -> DataFrame:
    """The name whatever its case, if that names one function, method or class: .5, in another language .3."""
    few = syms.filter(F.col("t_kind").isin("function", "method", "class")).withColumn("low", F.lower("t_name"))
    hit = refs.withColumn("low", F.lower(last_segment(F.col("reference_name")))).join(few, "low").filter("target != from_node_id").filter(language_gate())
    same = F.coalesce(F.col("language") == F.col("t_language"), F.lit(False))
    hit = hit.withColumn("any_same", F.max(same).over(W.partitionBy("ref_id"))).filter(~F.col("any_same") | same)
    hit = hit.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("ref_id"))).filter("n = 1")
    return _candidate(hit, F.when(same, 0.5).otherwise(0.3), "fuzzy", 4)


def by_function_value(refs: DataFrame, syms: DataFrame) -> DataFrame:
    """A function used as a value: of the same file .95 (several .9, the earliest), else the only one .8."""
    own = refs.filter(F.col("reference_kind") == "function_ref").withColumn("t_name", last_segment(F.col("reference_name")))
    hit = own.join(syms.filter(F.col("t_kind").isin("function", "method")), "t_name").filter("target != from_node_id").filter(F.coalesce(same_family(), F.lit(False)))
    here = F.col("file_path") == F.col("t_file")
    hit = hit.withColumn("here", here).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("ref_id", "here")))
    r = F.row_number().over(W.partitionBy("ref_id").orderBy(F.desc("here"), "t_line", "target"))
    best = hit.withColumn("r", r).filter("r = 1 AND (here OR n = 1)")
    return _candidate(best, F.when(F.col("here"), F.when(F.col("n") == 1, 0.95).otherwise(0.9)).otherwise(0.8), "function-ref", -1)


def by_import(refs: DataFrame, syms: DataFrame, imports: DataFrame) -> DataFrame:
    """A name that the file imports (``file_path, local, exported, module_file``): the exported symbol of that file .9."""
    local = F.regexp_extract("reference_name", r"^\w+", 0)
    b = imports.select(F.col("file_path").alias("i_file"), "local", "exported", "module_file")
    hit = refs.withColumn("local", local).join(b, ["local"]).filter("file_path = i_file")
    want = F.when(F.col("reference_name").rlike(r"\.|::"), last_segment(F.col("reference_name"))).otherwise(F.coalesce("exported", "local"))
    s = syms.withColumnRenamed("t_name", "want").withColumnRenamed("t_file", "module_file")
    hit = hit.withColumn("want", want).join(s, ["want", "module_file"]).withColumn("t_file", F.col("module_file"))
    r = F.row_number().over(W.partitionBy("ref_id").orderBy("t_line", "target"))
    return _candidate(hit.withColumn("r", r).filter("r = 1"), F.lit(0.9), "import", 0)


def by_document(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """References of documents: a path from the root or the document's folder .95, the only symbol of a name .9, the
    only document of a link's name .9."""
    own = refs.filter(F.col("reference_kind").startswith("doc_"))
    files = nodes.filter(F.col("kind").isin("file", "document")).select(F.col("id").alias("target"), F.col("kind").alias("t_kind"), F.col("file_path").alias("t_file"), F.lit(0).alias("t_line"))
    folder = directory(F.col("file_path"))
    path = own.filter("reference_kind = 'doc_path'").withColumn("cand", F.array(F.col("reference_name"), F.concat(folder, F.when(folder == "", "").otherwise("/"), F.col("reference_name"))))
    path = path.select("*", F.posexplode("cand").alias("pos", "t_file")).drop("cand").join(files, "t_file")
    r = F.row_number().over(W.partitionBy("ref_id").orderBy("pos", "target"))
    a = _candidate(path.withColumn("r", r).filter("r = 1"), F.lit(0.95), "file-path", 0)
    code = nodes.filter(~F.col("kind").isin("document", "section", "import", "parameter", "variable", "file")).select(F.col("id").alias("target"), F.col("kind").alias("t_kind"), F.col("file_path").alias("t_file"), F.coalesce("start_line", F.lit(0)).alias("t_line"), F.col("name").alias("t_name"))
    n = F.count(F.lit(1)).over(W.partitionBy("ref_id"))
    mention = own.filter("reference_kind IN ('doc_mention', 'doc_link')").withColumn("t_name", F.regexp_replace("reference_name", r"\(\)$", "")).join(code, "t_name").withColumn("n", n).filter("n = 1")
    docs = nodes.filter("kind = 'document'").select(F.col("id").alias("target"), F.col("kind").alias("t_kind"), F.col("file_path").alias("t_file"), F.lit(0).alias("t_line"), F.regexp_replace("name", r"\.md$", "").alias("t_name"))
    link = own.filter("reference_kind = 'doc_link'").withColumn("t_name", F.regexp_replace("reference_name", r"\.md$", "")).join(docs, "t_name").withColumn("n", n).filter("n = 1")
    return a.unionByName(_candidate(mention, F.lit(0.9), "exact-match", 2)).unionByName(_candidate(link, F.lit(0.9), "exact-match", 1))


_BY_NAME = ("file-path", "qualified-name", "instance-method", "exact-match", "fuzzy")


def pick(candidates: DataFrame) -> DataFrame:
    """The best candidate of each reference: the first of the ladder among those found by name, then by confidence."""
    named = F.col("resolved_by").isin(*_BY_NAME)
    first = F.min(F.when(named, F.col("ladder"))).over(W.partitionBy("ref_id"))
    kept = candidates.withColumn("_first", first).filter(~named | (F.col("ladder") == F.col("_first"))).drop("_first")
    r = F.row_number().over(W.partitionBy("ref_id").orderBy(F.desc("confidence"), "ladder", "t_file", "t_line", "target"))
    return kept.withColumn("r", r).filter("r = 1").drop("r")


def resolve(graph: Graph, refs: DataFrame | None = None, imports: DataFrame | None = None, extra_builtins: dict[str, list[str]] | None = None, more: list[Callable[[DataFrame, DataFrame], DataFrame]] = ()) -> DataFrame:
    """``ref_id, target, confidence, resolved_by`` with the reference's columns; ``more`` are registered strategies
    that take references and nodes and give candidates."""
    refs = checkpoint(with_ref_id(graph.refs if refs is None else refs))
    nodes = graph.nodes
    syms = symbols(nodes)
    docs = F.col("reference_kind").startswith("doc_")
    todo = prefilter(refs.filter(~docs & ~is_builtin(extra_builtins)), nodes)
    values = todo.filter("reference_kind = 'function_ref'")
    plain = todo.filter("reference_kind != 'function_ref'")
    found = by_document(refs.filter(docs), nodes).unionByName(by_function_value(values, syms))
    found = found.unionByName(by_file_path(plain, nodes)).unionByName(by_qualified_name(plain, syms)).unionByName(by_method(plain, syms)).unionByName(by_exact_name(plain, syms)).unionByName(by_fuzzy_name(plain, syms))
    if imports is not None:
        found = found.unionByName(by_import(plain, syms, imports))
    for strategy in (*more, *STRATEGIES):
        found = found.unionByName(strategy(plain, nodes))
    return refs.join(pick(found), "ref_id")


#: Strategies of frameworks and callers, in their order.
STRATEGIES: list[Callable[[DataFrame, DataFrame], DataFrame]] = []


def register_strategy(strategy: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    STRATEGIES.append(strategy)


def to_edges(resolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of resolved references, with kinds promoted by what was found."""
    s = nodes.select(F.col("id").alias("from_node_id"), F.col("kind").alias("s_kind"))
    e = resolved.join(s, "from_node_id")
    k, t = F.col("reference_kind"), F.col("t_kind")
    kind = (
        F.when(k == "function_ref", "references")
        .when((k == "extends") & t.isin("interface", "protocol", "trait") & ~F.col("s_kind").isin("interface", "protocol", "trait"), "implements")
        .when((k == "calls") & t.isin("class", "struct"), "instantiates")
        .when((k == "doc_link") & (t == "document"), "references")
        .when(k.startswith("doc_"), "mentions")
        .otherwise(k)
    )
    meta = F.to_json(F.struct("confidence", F.col("resolved_by").alias("resolvedBy"), F.col("reference_name").alias("refName"), k.alias("refKind"), F.when(k == "function_ref", True).alias("fnRef")))
    return e.select(F.col("from_node_id").alias("source"), "target", kind.alias("kind"), meta.alias("metadata"), "line", "column_no", F.lit("heuristic").alias("provenance"))


def resolution_stats(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("resolved_by").agg(F.count(F.lit(1)).alias("refs"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def inherited_members(graph: Graph, refs: DataFrame, depth: int = 5) -> DataFrame:
    """Second round: ``this.member`` and ``receiver.member`` left open are looked up in the supertypes of the class
    around the reference, nearest first, .85."""
    r = with_ref_id(refs).filter(F.col("reference_name").rlike(r"^(?:this|self|super)\.\w+$")).withColumn("member", last_segment(F.col("reference_name")))
    up = graph.edges.filter("kind IN ('extends', 'implements')").select(F.col("source").alias("cls"), F.col("target").alias("sup")).distinct()
    owner = graph.edges.filter("kind = 'contains'").select(F.col("target").alias("from_node_id"), F.col("source").alias("cls"))
    has = graph.edges.filter("kind = 'contains'").select(F.col("source").alias("cls"), F.col("target").alias("id")).join(graph.nodes.select("id", F.col("name").alias("member"), F.col("kind").alias("t_kind"), F.col("file_path").alias("t_file"), F.coalesce("start_line", F.lit(0)).alias("t_line")), "id").withColumnRenamed("id", "target")
    front = r.join(owner, "from_node_id").select("ref_id", "member", "cls")
    out = None
    for level in range(depth + 1):
        hit = front.join(has, ["cls", "member"]).select("ref_id", "target", "t_kind", "t_file", "t_line", F.lit(0.95 if not level else 0.85).alias("confidence"), F.lit("instance-method").alias("resolved_by"), F.lit(level).alias("ladder"))
        out = hit if out is None else out.unionByName(hit)
        if level < depth:
            front = front.join(up, "cls").select("ref_id", "member", F.col("sup").alias("cls")).distinct()
    near = W.partitionBy("ref_id").orderBy("ladder", "t_file", "t_line", "target")
    return r.drop("member").join(out.withColumn("r", F.row_number().over(near)).filter("r = 1").drop("r"), "ref_id")


def chase_exports(exports: DataFrame, depth: int = 8) -> DataFrame:
    """Re-exports followed to where a symbol is declared: ``file, name, origin_file, origin_name``.

    ``exports`` has ``file, name, from_file, from_name``: a direct export has no ``from_file``; ``from_name`` ``*``
    passes every name on. At most ``depth`` steps; a cycle ends by itself, as each (file, name) is met once."""
    direct = exports.filter("from_file IS NULL").select("file", "name", F.col("file").alias("origin_file"), F.col("name").alias("origin_name"))
    known = checkpoint(direct.distinct())
    new = known
    for _ in range(depth):
        via = exports.filter("from_file IS NOT NULL")
        named = via.filter("from_name != '*'").alias("v").join(new.alias("k"), (F.col("v.from_file") == F.col("k.file")) & (F.col("v.from_name") == F.col("k.name"))).select(F.col("v.file"), F.col("v.name"), "k.origin_file", "k.origin_name")
        star = via.filter("from_name = '*'").alias("v").join(new.alias("k"), F.col("v.from_file") == F.col("k.file")).select(F.col("v.file"), F.col("k.name"), "k.origin_file", "k.origin_name")
        got = named.unionByName(star).groupBy("file", "name").agg(F.min(F.struct("origin_file", "origin_name")).alias("s")).select("file", "name", "s.origin_file", "s.origin_name")
        new = checkpoint(got.join(known.select("file", "name"), ["file", "name"], "left_anti"))
        if new.isEmpty():
            break
        known = known.unionByName(new)
    return known


def probe_modules(wanted: DataFrame, files: DataFrame, extensions: list[str]) -> DataFrame:
    """``wanted_id, path``: the first existing file of a base path with the extensions in their order, the bare path
    last. ``wanted`` has ``wanted_id, base``."""
    tries = wanted.select("wanted_id", F.posexplode(F.array(*[F.concat("base", F.lit(e)) for e in [*extensions, ""]])).alias("pos", "path"))
    hit = tries.join(files.select("path").distinct(), "path")
    return hit.groupBy("wanted_id").agg(F.min(F.struct("pos", "path")).alias("s")).select("wanted_id", "s.path")
