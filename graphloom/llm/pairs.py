"""Problem 3: functions paired with their documentation.

``symbol_table`` reads every valid source file once: its named functions and methods, with a body or only declared, told
apart by qualified name and normalised types, each with the comment of its own; and the bases of its types. ``paired``
joins definitions without real documentation to separate declarations: an overload in the same type, or a method of an
interface, trait or class that the type extends or implements, directly or over others. Only then are those without
documentation dropped.

Documentation is real with ``MIN_WORDS`` words of prose besides those of the function's name.

Defined cases: null texts, null paths and other languages give no rows; files that do not parse give none; empty
documentation is none; a null repository is a repository like another; repeated rows give repeated pairs, but a
declaration counts once; a function defined twice is documented if one definition is.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, widen
from ..sources.functions import declarations
from ..sources.lexing import normalise
from .syntax import extension_has_grammar, language_of, verdict

MIN_WORDS = 5
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿가-힯]")
_MARKER = re.compile(r"^\s*(?:/\*[*!]?|//[/!]?|#[:!]?|\*(?!/))?\s?|\s*\*+/\s*$")
_TAG = re.compile(r"^\s*(?:[@\\](?P<tag>\w+)|:(?P<field>\w+))(?:\s*\{[^}]*\})?")
#: Tags that a parameter's or type's name follows.
_NAMED = frozenset("param arg argument parameter prop property key keyword keyparam kwarg kwparam var ivar cvar raises raise except exception throws type rtype template typeparam tparam see link author since version default memberof class name module namespace extends implements".split())
_DIRECTIVE = re.compile(
    r"^\s*(?:eslint|jshint|jslint|tslint|prettier|istanbul|c8 ignore|v8 ignore|@ts-|ts-ignore|noqa|pylint|flake8|mypy|pyright|pyre|type:\s*ignore|isort|fmt:|yapf|pragma|nolint|nosec|go:|\+build|lint:|golint|staticcheck|checkstyle|noinspection|sonar|NOSONAR|CHECKSTYLE|@formatter|clang-format|rustfmt|clippy|cspell|spell-checker|region\b|endregion\b|#region|#endregion|webpack|@vite|sourceMappingURL|-\*-|vim?:|coding[:=]|@?SuppressWarnings|biome-ignore|deno-lint|language=|export\s+\w+$)",
    re.I,
)
_PLACEHOLDER = re.compile(r"^\W*(?:TODO|FIXME|XXX|HACK|TBD|TBA|WIP|N/?A|undocumented|internal|see above|see below|ditto|lorem ipsum|placeholder|no doc\w*|docs?\s+(?:to come|needed|missing)|missing doc\w*|add (?:a )?(?:doc|description)\w*|description|write (?:me|this)|document (?:me|this)|auto-?generated method stub|your (?:code|description) here)\b", re.I)
_CODE = re.compile(
    r"[;{}]\s*$|^\s*(?:\}|\)|@\w+\()|^\s*(?:return|throw|yield|await|raise|del|goto)\b\s*[\w.\"'(\[{!-]*(?:\([^)]*\))?(?:\s*[-+*/%<>=&|]+\s*[\w.\"'()\[\]]+)*\s*;?\s*$"
    r"|^\s*(?:(?:const|let|var|final|auto|mut|int|long|float|double|bool|boolean|char|string|String)\s+)*[\w.\[\]]+(?:\s*:\s*[\w<>\[\]., ]+)?\s*(?:[-+*/%&|^]|<<|>>|:)?=(?!=)\s*\S"
    r"|^\s*(?:if|for|while|switch|elif|else if|foreach)\s*\(.*\)\s*\{?\s*$|^\s*(?:if|for|while|elif|else|try|with|def|class|match)\b[^.]*:\s*$|^\s*(?:def|fn|func|function|import|from|use|package|public|private|protected|static|struct|impl|interface|class)\s+[\w.:*{<(]+.*[({;:]?\s*$(?<=[({;:)\w])(?<!\w\w\w\.)"
    r"|^\s*[\w.]+\((?:[^()]|\([^()]*\))*\)\s*(?:[-+*/.].*)?$|=>|&&|\|\||^\s*[\w.]+(?:\+\+|--)$"
)
_HEADS = re.compile(r"^\s*(?:def|fn|func|function|import|from|use|package|public|private|protected|static|struct|impl|interface|class)\s")


def prose(doc: str | None) -> list[str]:
    """The words of prose in a comment or docstring."""
    return [w for line in _prose(doc) for w in line]


def _prose(doc: str | None) -> Iterator[list[str]]:
    """The words of each line."""
    fenced = False
    for line in (doc or "").split("\n"):
        line = _MARKER.sub("", line)
        line = _MARKER.sub("", line) if line.lstrip().startswith(("*", "/")) else line
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
            continue
        if fenced or _DIRECTIVE.match(line) or _PLACEHOLDER.match(line):
            continue
        if m := _TAG.match(line):
            tag, line = (m["tag"] or m["field"]).lower(), line[m.end() :]
            if tag in ("ts", "formatter", "suppresswarnings"):
                continue
            if m["field"]:
                name, _, line = line.partition(":")
                if not _:
                    line = name
            elif tag in _NAMED:
                line = re.sub(r"^\s*\[?[\w.$#*<>]+(?:=[^\]\s]*)?\]?\s*(?:-\s*)?", "", line)
        elif (m := re.match(r"^\s*([\w$]+)(?:\s*\([^)]*\))?\s*(?:--?|:)\s+(?=\S)", line)) and (re.match(r"^\s{2,}", line) or " - " in line[: m.end() + 1]):
            line = line[m.end() :]  # a list of parameters
        elif _code(line):
            continue
        if line.isascii():
            yield _WORD.findall(line)
        else:
            yield [w for w in _WORD.findall(line) if not _CJK.search(w)] + _CJK.findall(line)[::2]


def _code(line: str) -> bool:
    if not _CODE.search(line):
        return False
    if _HEADS.match(line):
        return bool(re.search(r"[({;=]", line)) or len(line.split()) <= 3
    return True


def name_words(name: str) -> set[str]:
    return {w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_a-zA-Z]+", name)} | {name.lower()}


def is_real(doc: str | None, name: str, least: int = MIN_WORDS) -> bool:
    """Whether the documentation says something."""
    if not doc:
        return False
    own = name_words(name)
    for words in _prose(doc):
        least -= sum(w.lower() not in own for w in words)
        if least <= 0:
            return True
    return False


#: Files that are read at a time: their texts and symbols are held by a worker at once.
_FILES = 200
_SYMBOL = "kind string, repo string, path string, language string, qualified_name string, name string, owner string, params int, types string, start_line int, end_line int, has_body boolean, own string, real boolean, signature string, code string"


def _symbols(with_code: bool):
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, _SYMBOL.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.freeze()
        gc.disable()  # tokens are many small tuples and no cycles
        for part in (batch.slice(at, _FILES) for batch in batches for at in range(0, batch.num_rows, _FILES)):
            rows = []
            for repo, path, text in zip(*(part.column(c).to_pylist() for c in ("repo", "path", "text"))):
                lang = language_of(path)
                if lang is None or text is None:
                    continue
                found, bases = declarations(lang, text)
                if not found or not verdict(lang, text)[0]:
                    continue
                source = normalise(text)
                for f in found:
                    owner = f.qualified_name.rpartition("::")[0].rpartition("::")[2] or path
                    more = (f.signature, source[f.start : f.end]) if with_code else (None, None)
                    rows.append(("function", repo, path, lang, f.qualified_name, f.name, owner, f.params, f.types, f.start_line, f.end_line, f.has_body, f.doc, is_real(f.doc, f.name), *more))
                rows += [("base", repo, path, lang, q, b, q.rpartition("::")[2], *[None] * 9) for q, b in set(bases)]
            gc.collect(0)
            columns = list(zip(*rows)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def symbol_table(files: DataFrame, code: bool = True) -> DataFrame:
    """The symbols of all valid files, each text read once: functions with and without a body, told apart by qualified
    name and normalised types, with the comment of their own; and the bases of types (``kind`` base: ``owner`` extends
    or implements ``name``). Signature and code are only filled with ``code``."""
    part = files.filter(F.col("path").isNotNull() & F.col("text").isNotNull() & extension_has_grammar(F.col("path"))).select("repo", "path", "text")
    return widen(part).mapInArrow(_symbols(code), _SYMBOL)


def _conforming(table: DataFrame) -> DataFrame:
    """``repo, language, sub, sup``: types of Go that have all methods of an interface of their package."""
    go = table.filter("kind = 'function' AND language = 'go'").withColumn("folder", F.regexp_replace("path", r"[^/]*$", ""))
    asked = go.filter("NOT has_body").select("repo", "folder", F.col("owner").alias("sup"), "name", "types").distinct()
    size = asked.groupBy("repo", "folder", "sup").agg(F.count(F.lit(1)).alias("_all"))
    has = go.filter("has_body AND qualified_name <> name").select(F.col("repo").alias("_repo"), F.col("folder").alias("_folder"), F.col("owner").alias("sub"), F.col("name").alias("_name"), F.col("types").alias("_types")).distinct()
    met = asked.join(has, F.col("repo").eqNullSafe(F.col("_repo")) & (F.col("folder") == F.col("_folder")) & (F.col("name") == F.col("_name")) & (F.col("types") == F.col("_types")))
    met = met.groupBy("repo", "folder", "sup", "sub").agg(F.count(F.lit(1)).alias("_met")).withColumnsRenamed({"repo": "_repo", "folder": "_folder", "sup": "_sup"})
    full = met.join(size, F.col("_repo").eqNullSafe(F.col("repo")) & (F.col("_folder") == F.col("folder")) & (F.col("_sup") == F.col("sup")) & (F.col("_met") == F.col("_all")))
    return full.select("repo", F.lit("go").alias("language"), "sub", "sup")


def _declared(table: DataFrame) -> DataFrame:
    """``repo, language, owner, name, types, params, declared``: documented declarations as every type that extends or
    implements theirs sees them. A declaration in a text collected again is one; of one name, types and owner that are
    declared in several files with different documentation the least is taken."""
    key = ["repo", "language"]
    own = table.filter("kind = 'function' AND NOT has_body AND real").select(*key, "owner", "name", "types", "params", F.col("own").alias("declared")).distinct()
    own = checkpoint(own.groupBy(*key, "owner", "name", "types", "params").agg(F.min("declared").alias("declared")))
    if own.isEmpty():
        return own
    up = table.filter("kind = 'base'").select(*key, F.col("owner").alias("sub"), F.col("name").alias("sup")).filter("sub <> sup")
    up = checkpoint(up.unionByName(_conforming(table)).distinct())
    # Level by level from the types that declare something down to those that define it.
    here = (F.col("repo").eqNullSafe(F.col("_repo"))) & (F.col("language") == F.col("_language"))
    seen = own.select(*key, F.col("owner").alias("base"), F.col("owner").alias("sub")).distinct()
    level = seen = checkpoint(seen)
    while True:
        u = up.select(F.col("repo").alias("_repo"), F.col("language").alias("_language"), F.col("sub").alias("_sub"), "sup")
        new = level.join(u, here & (F.col("sub") == F.col("sup"))).select(*key, "base", F.col("_sub").alias("sub")).distinct()
        s = seen.select(F.col("repo").alias("_repo"), F.col("language").alias("_language"), F.col("base").alias("_base"), F.col("sub").alias("_sub"))
        level = checkpoint(new.join(s, here & (F.col("base") == F.col("_base")) & (F.col("sub") == F.col("_sub")), "left_anti"))
        if level.isEmpty():
            break
        seen = checkpoint(seen.unionByName(level))
    s = seen.select(F.col("repo").alias("_repo"), F.col("language").alias("_language"), F.col("base").alias("_base"), "sub")
    out = own.join(s, here & (F.col("owner") == F.col("_base"))).select(*key, F.col("sub").alias("owner"), "name", "types", "params", "declared")
    return out.groupBy(*key, "owner", "name", "types", "params").agg(F.min("declared").alias("declared"))


def paired(files: DataFrame, code: bool = True) -> DataFrame:
    """Every definition with its documentation: its own comment if that is real, else the one of a separate declaration
    of its name in its own type (an overload) or in one that its type extends or implements, with the same normalised
    types; if none has these, the only declared one with as many parameters. Columns of ``symbol_table`` with
    ``documentation`` and ``source``: ``own``, ``declaration`` or null."""
    table = checkpoint(symbol_table(files, code))
    defined = table.filter("kind = 'function' AND has_body").drop("kind", "has_body")
    decl = _declared(table)
    cols = {c: f"_{c}" for c in ("repo", "language", "owner", "name")}
    d = decl.withColumnsRenamed(cols)
    same = F.lit(True)
    for c in cols:
        same = same & (F.col(c).eqNullSafe(F.col(f"_{c}")) if c == "repo" else F.col(c) == F.col(f"_{c}"))
    keys = [f"_{c}" for c in cols]
    typed = d.select(*keys, F.col("types").alias("_types"), F.col("declared").alias("_by_types"))
    counted = d.groupBy(*keys, F.col("params").alias("_params")).agg(F.min("declared").alias("_by_count"), F.max("declared").alias("_other")).filter("_by_count = _other").drop("_other")
    out = defined.join(typed, same & (F.col("types") == F.col("_types")), "left").drop(*keys, "_types")
    out = out.join(counted, same & (F.col("params") == F.col("_params")), "left").drop(*keys, "_params")
    declared = F.coalesce("_by_types", "_by_count")
    doc = F.when(F.col("real"), F.col("own")).otherwise(declared)
    source = F.when(F.col("real"), "own").when(F.col("documentation").isNotNull(), "declaration")
    return out.withColumn("documentation", doc).withColumn("source", source).drop("_by_types", "_by_count")


def graph_documentation(nodes: DataFrame) -> DataFrame:
    """``path, qualified_name, stated``: the newest docstring that the symbol graph has of a function or method, if it is
    real."""
    own = nodes.filter(F.col("kind").isin("function", "method") & F.col("qualified_name").isNotNull())
    s = F.max(F.struct(F.coalesce("updated_at", F.lit(-1)).alias("at"), "docstring", "name")).alias("s")
    top = own.groupBy(F.col("file_path").alias("path"), "qualified_name").agg(s).select("path", "qualified_name", F.col("s.docstring").alias("stated"), F.col("s.name").alias("_name"))

    @F.pandas_udf("boolean")
    def real(docs: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([is_real(d, n or "") for d, n in zip(docs, names)])

    return top.filter(F.length("stated") >= 2 * MIN_WORDS).filter(real("stated", "_name")).drop("_name")


def documented(files: DataFrame, nodes: DataFrame | None = None, code: bool = True) -> DataFrame:
    """Pairs of code and documentation, with ``source``: ``own``, ``declaration`` or ``graph`` (the docstring that the
    symbol graph has of a definition to which nothing else gave one)."""
    out = paired(files, code)
    if nodes is not None:
        out = out.join(graph_documentation(nodes), ["path", "qualified_name"], "left")
        out = out.withColumn("source", F.coalesce("source", F.when(F.col("stated").isNotNull(), "graph"))).withColumn("documentation", F.coalesce("documentation", "stated")).drop("stated")
    return out.filter("source IS NOT NULL").drop("real", "own", "types", "owner")


def found(files: DataFrame) -> DataFrame:
    """``repo, path, qualified_name`` of functions with real documentation. It is then checked to be the definition's
    own: the documentation of a function is what stands directly above it."""
    pairs = paired(files, code=False).filter("documentation IS NOT NULL")
    return pairs.filter(F.col("documentation") == F.col("own")).select("repo", "path", "qualified_name").distinct()
