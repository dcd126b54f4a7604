"""What a file's imports bind, and what its text says about the types of receivers.

``import_bindings`` gives ``file_path, local, exported, source`` by patterns of each language; ``resolve_bindings`` finds
the file that a source names. ``receiver_types`` finds, for calls of the form ``receiver.member``, the nearest
declaration of the receiver above the call within the enclosing function, from the tokens of each file.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import widen
from .extract import detect_language
from .frameworks import blank_comments
from .lexing import LANGUAGE_OF, normalise, tokens_of

#: Endings that are tried on a module's path, in order; the bare path comes last.
PROBES = {
    "typescript": [".ts", ".tsx", ".d.ts", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js"],
    "javascript": [".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", "/index.js", "/index.ts"],
    "python": [".py", "/__init__.py"],
    "rust": [".rs", "/mod.rs"],
    "go": [".go"],
    "java": [".java"],
}
PREFIXES = (("@/", "src/"), ("~/", "src/"), ("@src/", "src/"), ("@app/", "app/"))


def bindings(lang: str, text: str) -> list[tuple[str, str | None, str]]:
    """``local, exported, source`` in the order of the text; ``exported`` is ``*`` for a whole module and ``default``."""
    out: list[tuple[str, str | None, str]] = []
    if lang in ("javascript", "typescript", "jsx", "tsx"):
        for m in re.finditer(r"\bimport\s+(?:type\s+)?([\w$\s{},*]+?)\s+from\s*['\"]([^'\"]+)['\"]", text):
            what, src = m[1].strip(), m[2]
            if d := re.match(r"([\w$]+)\s*(?:,|$)", what):
                out.append((d[1], "default", src))
            if n := re.search(r"\*\s+as\s+([\w$]+)", what):
                out.append((n[1], "*", src))
            for one in re.findall(r"[\w$]+(?:\s+as\s+[\w$]+)?", (re.search(r"\{([^}]*)\}", what) or [None, ""])[1] or ""):
                a, _, b = one.partition(" as ")
                out.append(((b or a).strip(), a.strip(), src))
        for m in re.finditer(r"\b(?:const|let|var)\s+(?:([\w$]+)|\{([^}]*)\})\s*=\s*require\(\s*['\"]([^'\"]+)['\"]", text):
            if m[1]:
                out.append((m[1], "*", m[3]))
            for one in filter(None, (x.strip() for x in (m[2] or "").split(","))):
                a, _, b = one.partition(":")
                out.append(((b or a).strip(), a.strip(), m[3]))
    elif lang == "python":
        for m in re.finditer(r"^[ \t]*from\s+([.\w]+)\s+import\s+(?:\(([^)]*)\)|([^\n#]+))", text, re.M):
            for one in filter(None, (x.strip() for x in (m[2] or m[3]).replace("\\\n", " ").split(","))):
                a, _, b = (x.strip() for x in one.partition(" as "))
                if a != "*":
                    out.append((b or a, a, m[1]))
        for m in re.finditer(r"^[ \t]*import\s+([^\n#]+)", text, re.M):
            for one in m[1].split(","):
                a, _, b = (x.strip() for x in one.partition(" as "))
                out.append((b or a.split(".")[-1], "*", a))
    elif lang == "go":
        for block in re.finditer(r"^import\s+(?:\(([^)]*)\)|([^\n]+))", text, re.M):
            for m in re.finditer(r"(?:(\w+)\s+)?\"([^\"\n]+)\"", block[1] or block[2] or ""):
                out.append((m[1] or m[2].rsplit("/", 1)[-1], "*", m[2]))
    elif lang in ("java", "kotlin"):
        for m in re.finditer(r"^[ \t]*import\s+(?:static\s+)?([\w.]+)\.(\w+)\s*(?:as\s+(\w+))?\s*;?[ \t]*$", text, re.M):
            out.append((m[3] or m[2], m[2], m[1]))
    elif lang == "rust":
        for m in re.finditer(r"\buse\s+([^;]+);", text):
            out += _use("", " ".join(m[1].split()))
    elif lang == "php":
        for m in re.finditer(r"^[ \t]*use\s+([\w\\]+)\\(\w+)(?:\s+as\s+(\w+))?\s*;", text, re.M):
            out.append((m[3] or m[2], m[2], m[1]))
    elif lang in ("c", "cpp"):
        for m in re.finditer(r"^[ \t]*#[ \t]*include\s*[<\"]([^>\"]+)[>\"]", text, re.M):
            out.append((m[1].rsplit("/", 1)[-1], "*", m[1]))
    return out


def _use(prefix: str, tree: str) -> list[tuple[str, str | None, str]]:
    """The leaves of a use tree."""
    tree = tree.strip()
    if (at := tree.find("{")) >= 0:
        base, inside, depth, start, parts = prefix + tree[:at], tree[at + 1 : tree.rfind("}")], 0, 0, []
        for i, c in enumerate(inside + ","):
            depth += (c == "{") - (c == "}")
            if c == "," and not depth:
                parts.append(inside[start:i])
                start = i + 1
        return [x for p in parts if p.strip() for x in _use(base, p)]
    path, _, alias = tree.partition(" as ")
    full = (prefix + path).strip()
    head, _, last = full.rpartition("::")
    if last in ("*", ""):
        return []
    if last == "self":
        head, _, last = head.rpartition("::")
    return [((alias or last).strip(), last, head)]


def import_bindings(files: DataFrame) -> DataFrame:
    """``file_path, language, local, exported, source`` of all files (``path, text``)."""

    def run(parts):
        for p in parts:
            rows = []
            for path, text in zip(p["path"], p["text"]):
                lang = detect_language(path, text)
                if lang:
                    rows += [(path, lang, *b) for b in bindings(lang, blank_comments(lang, text))]
            yield pd.DataFrame(rows, columns=["file_path", "language", "local", "exported", "source"])

    return widen(files.filter("path IS NOT NULL AND text IS NOT NULL").select("path", "text")).mapInPandas(run, "file_path string, language string, local string, exported string, source string")


def _base(path: str, lang: str, source: str) -> list[str]:
    """Paths, without ending, that a source may mean."""
    folder = path.rsplit("/", 1)[0] if "/" in path else ""

    def join(a: str, b: str) -> str:
        parts: list[str] = []
        for x in f"{a}/{b}".split("/"):
            if x == "..":
                if parts:
                    parts.pop()
            elif x not in ("", "."):
                parts.append(x)
        return "/".join(parts)

    if lang == "python":
        dots = len(source) - len(source.lstrip("."))
        rest = source.lstrip(".").replace(".", "/")
        return [join(folder, "../" * (dots - 1) + rest)] if dots else [rest, join(folder, rest)]
    if lang in ("java", "kotlin"):
        return [source.replace(".", "/")]
    if lang == "rust":
        segs = [s for s in source.split("::") if s]
        if segs and segs[0] in ("crate", "self", "super"):
            up = {"crate": "src", "self": folder, "super": join(folder, "..")}[segs[0]]
            return [join(up, "/".join(segs[1:]))]
        return [join(folder, "/".join(segs)), join("src", "/".join(segs))]
    if source.startswith("."):
        return [join(folder, source)]
    return [join(b, source[len(a) :]) for a, b in PREFIXES if source.startswith(a)] + [source]


def resolve_bindings(bound: DataFrame, files: DataFrame) -> DataFrame:
    """Bindings with ``module_file``: the first existing file among the candidates of their source, in order."""

    @F.pandas_udf("array<string>")
    def tries(path: pd.Series, lang: pd.Series, source: pd.Series) -> pd.Series:
        return pd.Series([[b + e for b in _base(p, la, s) for e in [*PROBES.get(la, []), ""]] for p, la, s in zip(path, lang, source)])

    each = bound.select("*", F.posexplode(tries("file_path", "language", "source")).alias("_pos", "module_file"))
    hit = each.join(files.select(F.col("path").alias("module_file")).distinct(), "module_file")
    best = hit.groupBy(*bound.columns).agg(F.min(F.struct("_pos", "module_file")).alias("s"))
    return best.select(*bound.columns, F.col("s.module_file").alias("module_file"))


class Declarations:
    """What a text's tokens say about the types of names; no types, no scopes but lines."""

    def __init__(self, lang: str, text: str):
        tokens = tokens_of(lang, text)
        code = [(w, k, s) for w, k, s in zip(tokens.words, tokens.kinds, tokens.starts) if k not in "clte"]
        self.lang, self.words, self.kinds = lang, [w for w, _, _ in code], [k for _, k, _ in code]
        starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.lines = [bisect_right(starts, s) for _, _, s in code]
        self.places: dict[str, list[int]] = {}
        for i, w in enumerate(self.words):
            if self.kinds[i] == "w" and (not i or self.words[i - 1] not in (".", "?.", "::")):
                self.places.setdefault(w, []).append(i)

    def type_of(self, name: str, call: int, first: int) -> str | None:
        """By the nearest declaration of ``name`` from line ``call`` back to line ``first``."""
        for i in reversed(self.places.get(name, ())):
            if first <= self.lines[i] <= call and (found := self._made(i) or self._noted(i)):
                return found
        return None

    def _word(self, i: int) -> str:
        return self.words[i] if 0 <= i < len(self.words) else ""

    def _path(self, i: int) -> tuple[str | None, int]:
        """The last part of the dotted name that starts at ``i`` (behind signs that do not change the type), if it is
        written like a type, and the place behind the name."""
        while self._word(i) in ("&", "*", "mut", "?", "await", "dyn") or i < len(self.kinds) and self.kinds[i] == "u":
            i += 1
        last = None
        while i < len(self.kinds) and self.kinds[i] == "w":
            if self.words[i][0].isupper():
                last = self.words[i]
            elif last:
                break
            if self._word(i + 1) not in (".", "::"):
                i += 1
                break
            i += 2
        return last, i

    def _made(self, i: int) -> str | None:
        """The name gets a new value of a type: the type's name is called, or opens a literal."""
        j = i + 1
        if self._word(j) == ":":
            return None
        if self._word(j) not in ("=", ":="):
            return None
        fresh = self._word(j + 1) == "new"
        name, behind = self._path(j + 1 + fresh)
        opened = self._word(behind) in ("(", "{", "<") or self._word(behind - 1) == "::" or self.kinds[behind : behind + 1] == ["w"] and self._word(behind - 1) in (".", "::")
        return name if name and (fresh or opened) else None

    def _noted(self, i: int) -> str | None:
        """A type stands beside the name: behind a colon, right behind it, or before it."""
        j = i + 1
        if self._word(j) in (":", "?") and self.lang not in ("go", "java"):
            j += 1 + (self._word(j) == "?")
            return self._path(j)[0]
        if self.lang == "go":
            return self._path(j)[0] if self._word(i - 1) in ("var", "(", ",") else None
        if self.lang == "java" and self._word(j) in ("=", ";", ",", ")", ":"):
            b, depth = i - 1, 0
            while b >= 0 and (depth or self._word(b) in (">", "]", "[")):
                depth += (self.words[b] == ">") - (self.words[b] == "<")
                b -= 1
            return self.words[b] if b >= 0 and self.kinds[b] == "w" and self.words[b][0].isupper() else None
        return None


def nearest_type(lang: str, lines: list[str], receiver: str, call: int, first: int) -> str | None:
    """The type of the nearest declaration from line ``call`` back to line ``first``."""
    return Declarations(lang, "\n".join(lines)).type_of(receiver, call, first)


def receiver_types(refs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """``from_node_id, reference_name, line, receiver, type_name``; ``texts`` has ``path, text``. References meet their
    file's text once: they are gathered by file, so a text is not repeated for each of them."""
    start = nodes.filter("kind IN ('function', 'method')").select(F.col("id").alias("from_node_id"), F.coalesce("start_line", F.lit(1)).alias("first"))
    r = refs.filter(F.col("reference_name").rlike(r"^\w+\.\w+$") & F.col("line").isNotNull()).select("from_node_id", "reference_name", "line", F.col("file_path").alias("path")).distinct()
    r = r.join(start, "from_node_id", "left").withColumn("first", F.coalesce("first", F.lit(1)))
    # A file's references in parts of at most a few thousand, so that no group is unbounded.
    part = F.floor(F.col("line") / 2000)
    per = r.groupBy("path", part.alias("_part")).agg(F.collect_set(F.struct("from_node_id", "reference_name", "line", "first")).alias("refs"))
    both = per.join(texts.select("path", "text"), "path")

    def run(parts):
        for p in parts:
            rows = []
            for path, refs_, text in zip(p["path"], p["refs"], p["text"]):
                lang = detect_language(path, text or "")
                if text is None or lang not in LANGUAGE_OF.values():
                    continue
                said = Declarations(lang, normalise(text))
                for x in refs_:
                    recv = x["reference_name"].split(".")[0]
                    if t := said.type_of(recv, x["line"], x["first"]):
                        rows.append((x["from_node_id"], x["reference_name"], x["line"], recv, t))
            yield pd.DataFrame(rows, columns=["from_node_id", "reference_name", "line", "receiver", "type_name"])

    return both.mapInPandas(run, "from_node_id string, reference_name string, line int, receiver string, type_name string")
