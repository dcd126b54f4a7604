"""Problem 1: generated, minified, vendored and data files among source files.

A file is named with the first of these reasons that holds:

* ``large``: more than 1 MiB and no text to judge;
* ``generated``: its leading comment says that a tool wrote it, or its name is one that only tools give;
* ``minified``: its code is packed in long lines almost without blanks;
* ``data``: most of its tokens are literals of a table, or most of its text is one encoded string;
* ``vendored``: most of its winnowed fingerprints recur in ``MANY`` repositories, or in ``FEW`` and its folder or its
  leading comment says that it is a copy; only without a text the folder decides.

Fingerprints: hashes of all runs of ``RUN`` tokens of the normalised stream (the lexer's tokens without comments, blanks
and line ends; strings and regular expressions are one class each), of which winnowing keeps the least of every
``WINDOW``; so any copied stretch of RUN + WINDOW - 1 tokens shares one, however it is laid out. The repositories of a
fingerprint are counted over all texts, each text has its share by itself, and a text collected again changes neither;
fingerprints with a large part of all rows are joined by a broadcast table that cannot exceed ``1 / HOT`` rows.
Comments that merely mention tools, copies or headers do not count, nor do folders that only sound alike. A text that
belongs to another type of file is none of these.

Defined cases: null texts count as absent; empty texts have no reason; repeated rows and several versions of a text of
one path are judged together (one reason suffices); null paths are never named; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, widen
from ..sources.lexing import LANGUAGE_OF, _kinds, normalise, tokens_of
from .syntax import language_of, verdict

RUN, WINDOW = 32, 32
MANY, FEW, SHARE = 4, 2, 0.6
HOT = 1e-4
LARGE = 1 << 20

#: Tokens of files in a language without a lexer.
_TOKEN = re.compile(r"\w+|[^\w\s]")
_BASE = 0x9E3779B97F4A7C15
_GENERATED_NAME = re.compile(
    r"[._-](?:generated|gen|autogen|designer)\.\w+$|(?:_pb2|_pb2_grpc|_grpc_pb|_pb|\.pb|\.pb\.gw|\.g|\.freezed|\.moc|_string|_easyjson|\.zap)\.\w+$|(?:^|/)(?:zz_generated[\w.]*|moc_\w+|ui_\w+)\.\w+$|(?:^|/)(?:generated|__generated__|autogenerated|\.gen|gen-src|generated-sources|auto_generated)/",
    re.I,
)
_NOT_NAME = re.compile(r"_string\.\w+$|(?:^|/)ui_\w+\.\w+$|\.g\.(?:go|rs|py|java)$")
#: How a tool's notice begins; a sentence about such notices begins otherwise.
_NOTICE = re.compile(
    r"^(?:@generated\b|<auto-?generated|(?:this|the) (?:file|code|source|module|class|program)(?: \S+)? (?:is|was|has been) (?:(?:auto|automatically|machine|mechanically|programmatically)[- ]?)?(?:generated|created by a tool|produced by)"
    r"|(?:auto|automatically|machine|mechanically)[- ]?(?:generated|written|produced|created)\b|code generated\b|generated (?:by|from|with|using|automatically|code|file|source|at|on)\b|do not (?:edit|modify|change)\b|(?:auto-?gen(?:erated)?)\b.*\b(?:by|from|file)\b|output of the\b.*\bdo not edit)",
    re.I,
)
_DENIED = re.compile(r"\b(?:not|never|no longer|isn't|wasn't)\s+(?:\w+[- ]){0,2}generated\b|\b(?:kept|edited|maintained|changed|written|extended) by hand\b|\bhand[- ](?:written|maintained|edited)\b|edit (?:it )?freely", re.I)
_COPY = re.compile(
    r"^(?:(?:vendored|verbatim|unmodified|local|bundled) copy of|vendored (?:from|copy|in from)|(?:imported|copied|taken|ported) (?:unchanged|verbatim|unmodified|as is|without changes|in full)?\s*from\b.*\b(?:release|version|distribution|upstream|v?\d+\.\d+)|snapshot of upstream|upstream (?:copy|snapshot|source)\b|mirror(?:ed)? (?:of|from) upstream|\S+ v?\d+(?:\.\d+)+\s*[|:-].*\b(?:third[- ]party|bundled|vendored|upstream)\b|(?:third[- ]party|3rd[- ]party) (?:code|source|library)\b)",
    re.I,
)
_PACKAGES = frozenset("node_modules bower_components jspm_packages pods carthage third_party third-party thirdparty 3rdparty 3rd_party vendor vendored _vendor godeps site-packages web_modules".split())
_COPIES = _PACKAGES | frozenset("deps extern externals external contrib libs".split())
_MARK = re.compile(r"^\s*(?:/\*[*!]?|//[/!]?|#[:!]?|\*(?!/)|\"\"\"|'''|r\"\"\"|<!--|--)?\s*")
_WEB = re.compile(r"\s*<(?:!doctype|html|\?xml|svg|head|body)\b", re.I)
_SETTING = re.compile(r"^\s*(?:- )?[\w.\"'-]+\s*:(?:\s+\S.*)?$|^\s*- \S|^\s*#|^\s*$|^---$")
_LITERAL = re.compile(r"0[xX][\da-fA-F]+|[-+]?\d[\d_.]*(?:[eE][-+]?\d+)?|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
_ENCODED = re.compile(r"[\"'`](?:[A-Za-z0-9+/=_-]|\\n|\\\n|\\x[\da-f]{2}|\"\s*[+\\]?\s*\")*[\"'`]")
_LONG = re.compile(r"[^\n]{151}")
_COMMENTS = re.compile(r"/\*[\s\S]*?\*/|^\s*(?://|#)[^\n]*", re.M)


class _Codes(dict):
    """Numbers of a language's tokens, zero for those that do not count; forgotten when there are too many."""

    def __init__(self, lang: str | None = None):
        super().__init__()
        self.kinds = _kinds.get(lang)

    def __missing__(self, w: str) -> int:
        kind = self.kinds[w] if self.kinds is not None else "w"
        c = 0 if kind in "clxe" else _CLASSES.get(kind) or crc32(w.encode("utf-8", "surrogatepass")) * 0x9E3779B1 & 0x7FFFFFFFFFFFFFFF | 1
        if len(w) <= 40:
            if len(self) > 500_000:
                self.clear()
            self[w] = c
        return c


_CLASSES = {"s": 4, "r": 6, "t": 8}


def fingerprints(text: str, codes: _Codes, lang: str | None = None) -> np.ndarray:
    """The winnowed fingerprints of a text, each once. RUN and WINDOW are powers of two, reached by doubling."""
    words = tokens_of(lang, normalise(text)).words if lang else _TOKEN.findall(text)
    h = np.fromiter(map(codes.__getitem__, words), np.int64, len(words)).view(np.uint64)
    h = h[h != 0]
    if not len(h):
        return np.empty(0, np.int64)
    if len(h) < RUN:
        h = np.concatenate([h, np.zeros(RUN - len(h), np.uint64)])
    k = 1
    while k < RUN:
        h = h[:-k] * np.uint64(pow(_BASE, k, 1 << 64)) + h[k:]
        k *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    k = 1
    while k < WINDOW and len(h) > k:
        h = np.minimum(h[:-k], h[k:])
        k *= 2
    return np.unique(h).view(np.int64)


def _lead(text: str) -> list[str]:
    """The lines of the leading comments, without their marks: all before the first code."""
    out, block, doc, at = [], False, None, 0
    while at <= len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        s, at = text[at:end].strip("﻿ \t\r\f\v"), end + 1
        if not s:
            continue
        if doc:
            out.append(s.split(doc)[0])
            if doc in s:
                doc = None
        elif not block and (m := re.match(r"[rRuU]?(\"\"\"|''')", s)):
            out.append(s[m.end() :].split(m[1])[0])
            doc = None if m[1] in s[m.end() :] else m[1]
        elif block or s.startswith("/*"):
            while block or s.startswith("/*"):
                inside, closed, rest = s[0 if block else 2 :].partition("*/")
                out.append(_MARK.sub("", inside if block else "/*" + inside))
                block, s = not closed, rest.strip()
                if block:
                    break
            if s.startswith("//"):
                out.append(_MARK.sub("", s))
            elif s:
                break  # code behind the comment
        elif s.startswith(("//", "#!", "# ", "#-", "#=", "#@", "##")) or s == "#" or re.match(r"#\s*\w", s) and not re.match(r"#(?:include|define|if|pragma|\[)", s):
            out.append(_MARK.sub("", s))
        else:
            break
    return [x.strip(" *-=/#") if not x.startswith("@") else x for x in out]


def says(text: str, what: re.Pattern) -> bool:
    lead = [x for x in _lead(text) if x]
    return any(what.match(x) for x in lead) and not any(_DENIED.search(x) for x in lead)


def generated_name(path: str) -> bool:
    return bool(_GENERATED_NAME.search(path)) and not _NOT_NAME.search(path)


def minified(text: str) -> bool:
    if len(text) < 300 or "/*" not in text and not _LONG.search(text):
        return False  # no line of the code can be long; without block comments none grows when comments go
    body = _COMMENTS.sub("", text)
    lines = [x for x in body.split("\n") if x.strip()]
    if not lines or len(body) < 300:
        return False
    blanks = sum(x.count(" ") + x.count("\t") for x in lines)
    size = sum(map(len, lines))
    return size / len(lines) > 150 and blanks / size < 0.12 and not tabular(text)


def tabular(text: str) -> bool:
    """Mostly literals of a table, or one encoded string."""
    body = _COMMENTS.sub("", text)
    size = len("".join(body.split()))
    if size < 200:
        return False
    encoded = max((len(m[0]) for m in _ENCODED.finditer(body)), default=0)
    if encoded > 200 and encoded > 0.7 * size:
        return True
    bare = _LITERAL.sub("\u0001", body)
    n = bare.count("\u0001")
    return n > 40 and n > 0.75 * len(re.findall(r"\u0001|\w+", bare)) and bare.count(",") + bare.count("\n") >= 0.5 * n


def folder_says(path: str) -> bool:
    """Whether the file lies in a folder that holds copies."""
    return not _COPIES.isdisjoint(path.lower().split("/")[:-1])


def other_type(path: str, text: str) -> bool:
    """Whether the text belongs to another type of file than the path says."""
    lang = language_of(path)
    if lang is None:
        return False
    if _WEB.match(text):
        return True
    if verdict(lang, text)[0]:
        return False
    lines = [x for x in text.split("\n") if x.strip()]
    if lines and sum(bool(_SETTING.match(x)) for x in lines) > 0.9 * len(lines):
        return True
    if text.lstrip()[:1] in "{[":
        try:
            json.loads(text)
            return True
        except ValueError:
            pass
    return any(verdict(x, text)[0] for x in LANGUAGE_OF.values() if x != lang and not (lang == "javascript" and x == "typescript"))


_SIGNS = "repo string, path string, own string, copy int, fingerprints array<long>"
_ARROW = pa.schema([("repo", pa.string()), ("path", pa.string()), ("own", pa.string()), ("copy", pa.int32()), ("fingerprints", pa.list_(pa.int64()))])


def _signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = {lang: _Codes(lang) for lang in (None, *LANGUAGE_OF.values())}
    for batch in batches:
        rows, prints = [], []
        for repo, path, text in zip(*(batch.column(c).to_pylist() for c in ("repo", "path", "text"))):
            own = "generated" if says(text, _NOTICE) or generated_name(path) else "data" if tabular(text) else "minified" if minified(text) else None
            copy = 1 if folder_says(path) or says(text, _COPY) else 0
            if _WEB.match(text) or ((own or copy) and other_type(path, text)):
                own, copy = None, -1
            rows.append((repo, path, own, copy))
            lang = language_of(path)
            prints.append(fingerprints(text, tables[lang], lang))
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 4, _ARROW)]
        ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in prints], dtype=np.int64)]), pa.int32())
        lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int64), *prints]), pa.int64()))
        yield pa.RecordBatch.from_arrays([*columns, lists], schema=_ARROW)


def signs(docs: DataFrame) -> DataFrame:
    """What each text says by itself, and its fingerprints. ``copy``: 1 if its folder or its leading comment says that it
    is a copy, -1 if it can be none."""
    part = docs.filter(F.col("path").isNotNull() & F.col("text").isNotNull()).select("repo", "path", "text")
    return widen(part).mapInArrow(_signs, _SIGNS)


def recurrence(signed: DataFrame) -> DataFrame:
    """``d, many, few``: the parts of the text's fingerprints that recur in ``MANY`` and ``FEW`` repositories; ``signed``
    has a number ``d`` for each text."""
    one = signed.select("d", F.xxhash64("repo").alias("r"), F.explode("fingerprints").alias("f"))
    total = signed.agg(F.sum(F.size("fingerprints"))).first()[0] or 0
    count = one.groupBy("f", "r").agg(F.count(F.lit(1)).alias("n")).groupBy("f").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    count = checkpoint(count.filter(F.col("repos") >= FEW))
    hot = count.filter(F.col("n") > HOT * total).select("f", "repos")  # fewer than 1 / HOT rows
    cold = count.filter(F.col("n") <= HOT * total).select("f", "repos")
    one = one.select("d", "f")
    met = one.join(F.broadcast(hot), "f").select("d", "repos").unionByName(one.join(F.broadcast(hot), "f", "left_anti").join(cold, "f").select("d", "repos"))
    met = met.groupBy("d").agg(F.count(F.lit(1)).alias("few"), F.sum((F.col("repos") >= MANY).cast("int")).alias("many"))
    out = met.join(signed.select("d", F.size("fingerprints").alias("_n")), "d")
    return out.select("d", (F.col("many") / F.col("_n")).alias("many"), (F.col("few") / F.col("_n")).alias("few"))


def not_hand_written(files: DataFrame, docs: DataFrame) -> DataFrame:
    """``repo, path, reason`` of the files that nobody writes by hand."""
    signed = checkpoint(signs(docs).withColumn("d", F.monotonically_increasing_id()))
    by_text = signed.drop("fingerprints").join(recurrence(signed), "d", "left")
    share = lambda c: F.coalesce(F.col(c), F.lit(0.0)) >= SHARE
    copied = ((F.col("copy") >= 0) & share("many")) | ((F.col("copy") == 1) & share("few"))
    judged = by_text.select("repo", "path", F.coalesce("own", F.when(copied, "vendored")).alias("_why"))
    judged = judged.groupBy("repo", "path").agg(F.min("_why").alias("_why"), F.lit(True).alias("_text"))
    known = files.filter(F.col("path").isNotNull()).groupBy("repo", "path").agg(F.max("size").alias("size"))
    parts = F.split(F.lower("path"), "/")
    owned = F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, sorted(_PACKAGES))))
    bare = F.when(F.col("size") > LARGE, "large").when(owned, "vendored").when(F.col("path").rlike(r"(?i)[._-](?:generated|min|bundle)\.\w+$|(?:_pb2|_pb2_grpc|_grpc_pb|\.pb)\.\w+$|(?:^|/)generated/"), "generated")
    out = known.join(judged, ["repo", "path"], "left").withColumn("reason", F.when(F.col("_text"), F.col("_why")).otherwise(bare))
    return out.filter(F.col("reason").isNotNull()).select("repo", "path", "reason")
