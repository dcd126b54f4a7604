"""Problem 5: source files that do not parse.

``flag_unparsable`` runs the generalised LL recogniser of ``gll`` over whole files, all dialects of the language
together; a file is flagged when every dialect rejects it. Rejections of Python are confirmed by the standard parser;
nothing takes the recogniser's place.

Defined cases: a null text is not judged (``valid`` null), an empty or comment-only one is valid; an extension without
a grammar gives ``valid`` null; repeated rows are judged each; extra columns pass through unless they carry a name that
the operator writes, which it then replaces.
"""

from __future__ import annotations

import ast
import os
import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import widen
from ..sources.lexing import KEPT_WORDS, LANGUAGE_OF, _kinds, normalise, python_tree, tokens_of
from .gll import Grammar
from .grammars import grammar

#: Opening brackets, also as they stand behind a line end where that matters, and what they are closed by.
_GROUP = {"(": ("p", ")"), "[": ("s", "]"), "{": ("b", "}"), "\x01": ("e", "}"), "\x02": ("p", ")"), "\x03": ("s", "]"), "\x04": ("b", "}"), "\x05": ("e", "}")}
_BRACKET = re.compile("([][(){}\x01-\x05])")
_LINES = re.compile("\n+(.)", re.S)
#: Python's line ends stand for the width of the indentation that follows.
_WIDTH = 0x10000
_INDENT = re.compile("([\U00010000-\U0001ffff])")
#: Go ends a statement at a line end after one of these.
_GO_END = "break continue fallthrough return ++ -- ) ] }".split()
#: Names of token classes, which are ordinary words in a text.
_NAMES = frozenset("id num str life regex tmpl tend priv name nl".split())
VERDICT = T.StructType([T.StructField("valid", T.BooleanType()), T.StructField("language", T.StringType()), T.StructField("reason", T.StringType())])


class _Classes(dict):
    """The grammar's character for a token of a language, by its text; nothing for comments, a line end for line ends."""

    def __init__(self, lang: str):
        super().__init__()
        self.lang, self.kinds, chars = lang, _kinds[lang], grammar(lang).chars[0]
        self.chars, self.unknown, self.own = chars, chars["?"], chars["id"]
        self.other = {k: chars[n] for k, n in {"n": "num", "s": "str", "u": "life", "r": "regex", "t": "tmpl", "e": "tend"}.items() if n in chars}

    def __missing__(self, w: str) -> str:
        c = self.of(self.kinds[w], w)
        if len(w) <= 40:
            if len(self) > KEPT_WORDS:
                self.clear()
            self[w] = c
        return c

    def of(self, kind: str, w: str) -> str:
        if kind == "w":
            c = self.chars.get(w)
            return c if c is not None and w not in _NAMES else self.chars["priv"] if w[0] == "#" else self.own
        if kind == "p":
            return "\x01" if w == "${" else w if w in "()[]{}" else self.chars.get(w) or self.unknown
        if kind == "l":
            return "\n" if self.lang != "python" else chr(_WIDTH + _width(w[1:]))
        if kind == "c":
            return "\n" if "\n" in w and self.lang != "python" else ""
        return "\0" if kind == "z" else self.other.get(kind, "")


@cache
def _classes(lang: str) -> _Classes:
    return _Classes(lang)


@cache
def _go_lines() -> tuple[re.Pattern, str]:
    chars = grammar("go").chars[0]
    ends = "".join(re.escape(x if x in ")]}" else chars[x]) for x in (*_GO_END, "id", "num", "str"))
    return re.compile(f"([{ends}])\n+"), chars[";"]


def shape(lang: str, text: str) -> tuple[str, str | None]:
    """The file as a string of token classes, groups folded; and why it cannot be one."""
    tokens, table = tokens_of(lang, text), _classes(lang)
    if tokens.error:
        return "", tokens.error
    g = grammar(lang)
    s = "".join(map(table.__getitem__, tokens.words) if tokens.easy else map(table.of, tokens.kinds, tokens.words))
    if "\0" in s:
        return "", tokens.unread()
    python = lang == "python"
    if lang == "go":
        ends, semicolon = _go_lines()
        s = ends.sub(rf"\1{semicolon}", s + "\n").replace("\n", "")
    elif lang in ("javascript", "typescript"):
        marked = g.marked
        s = _LINES.sub(lambda m: marked.get(m[1], m[1]), s).rstrip("\n")
    elif not python:
        s = s.replace("\n", "")
    group, asks = g.group, g.asks
    parts = _BRACKET.split(s)
    stack: list[tuple[str, list[str], int]] = []
    out = [parts[0]]
    for i in range(1, len(parts), 2):
        b = parts[i]
        if b in _GROUP:
            # what stands before the bracket says what may be in it
            c = out[-1][-1:] or (out[-2] if len(out) > 1 else "")
            stack.append((b, out, asks(_GROUP[b][0], c) if not python or c and not "\U00010000" <= c < "\U00020000" else -1))
            out = [parts[i + 1]]
            continue
        if not stack or _GROUP[stack[-1][0]][1] != b:
            return "", f"unmatched {b}"
        o, up, asked = stack.pop()
        inside = "".join(out)
        c = group(_GROUP[o][0], _INDENT.sub("", inside) if python else inside, asked)
        up.append(chr(ord(c) | 1) if o < " " and o != "\x01" else c)
        up.append(parts[i + 1])
        out = up
    if stack:
        return "", "a bracket is never closed"
    s = "".join(out)
    return _suites(g, s, _width(text[: tokens.starts[0]])) if python and s else (s, None)


def _width(blanks: str) -> int:
    return min(0xFFFF, len(blanks.replace("\f", "").expandtabs(8)))


def _suites(g: Grammar, s: str, first: int) -> tuple[str, str | None]:
    """Python's lines as a string in which suites are folded; ``first``: the first line's indentation."""
    nl = g.chars[0]["nl"]
    indents, blocks, out = [0], [], []
    lines = _INDENT.split(s)
    for i in range(-1, len(lines), 2):
        line = lines[i + 1] if i + 1 < len(lines) else ""
        if not line:
            continue
        width = ord(lines[i]) - _WIDTH if i > 0 else first
        if width > indents[-1]:
            indents.append(width)
            blocks.append(out)
            out = []
        while width < indents[-1]:
            indents.pop()
            c = g.group("i", "".join(out))
            out = blocks.pop()
            out.append(c)
        if width != indents[-1]:
            return "", "inconsistent indentation"
        out.append(line + nl)
    while blocks:
        c = g.group("i", "".join(out))
        out = blocks.pop()
        out.append(c)
    return "".join(out), None


def verdict(lang: str | None, text: str | None) -> tuple[bool | None, str | None]:
    """Whether the text is valid in the language, and why not."""
    if lang not in LANGUAGE_OF.values() or text is None:
        return None, None
    source = normalise(text)
    s, error = shape(lang, source)
    g = grammar(lang)
    if error is None and not (g.dialects(s) if s else True):
        error = "rejected by every dialect: " + ", ".join(g.starts)
    if error and lang == "python" and isinstance(python_tree(source), ast.AST):
        error = None
    return error is None, error


def language_of(path: str | None) -> str | None:
    return LANGUAGE_OF.get(os.path.splitext(path or "")[1].lower())


@F.pandas_udf(VERDICT)
def _verdicts(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    import gc

    gc.freeze()
    gc.disable()  # the recogniser makes many small tuples and no cycles that outlive a file
    for paths, texts in parts:
        rows = []
        for n, (path, text) in enumerate(zip(paths, texts)):
            lang = language_of(path)
            ok, why = verdict(lang, text)
            rows.append((ok, lang, why))
            if n % 200 == 0:
                gc.collect(0)
        yield pd.DataFrame(rows, columns=["valid", "language", "reason"]).astype({"valid": object})


def extension_has_grammar(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0)).isin(*LANGUAGE_OF)


def flag_unparsable(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Every row with ``valid``, ``language`` (of the extension) and ``reason`` (null if valid)."""
    v = widen(files).withColumn("_v", _verdicts(F.col(path), F.col(text)))
    return v.withColumns({c: F.col(f"_v.{c}") for c in ("valid", "language", "reason")}).drop("_v")


def invalid_rates(flagged: DataFrame, by: tuple[str, ...] = ("repo", "language")) -> DataFrame:
    """Files, invalid files and their rate per repository and language."""
    judged = flagged.filter(F.col("valid").isNotNull())
    n, bad = F.count(F.lit(1)).alias("files"), F.sum((~F.col("valid")).cast("long")).alias("invalid_files")
    return judged.groupBy(*by).agg(n, bad).withColumn("invalid_rate", F.round(F.col("invalid_files") / F.col("files"), 6))
