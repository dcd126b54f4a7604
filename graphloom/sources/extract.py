"""Source files to nodes, edges, references and diagnostics; documents to sections and outward references.

One pass over each file in Arrow batches gives a tagged union of rows, which is written once and filtered three ways.
Python comes from its own parser; the other five languages from the token scanner; further languages are recognised by
name and reported as unsupported.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, widen
from .functions import _Lines, _Scan, comment_lines, functions
from .lexing import LANGUAGE_OF, normalise, python_tree, tokens_of

MAX_BYTES = 1 << 20
MAX_NESTING = 4096
MAX_SECTION = 4096
#: Extension to language; fixed names of the data model. Several extensions of one language stand together.
EXTENSIONS = {
    e: lang
    for lang, es in {
        "python": "py pyi pyw", "javascript": "js mjs cjs", "jsx": "jsx", "typescript": "ts mts cts", "tsx": "tsx", "go": "go", "java": "java", "rust": "rs", "kotlin": "kt kts",
        "c": "c h", "cpp": "cc cpp cxx hpp hh hxx", "csharp": "cs", "php": "php", "ruby": "rb", "swift": "swift", "scala": "scala", "lua": "lua", "dart": "dart", "yaml": "yml yaml",
        "properties": "properties", "twig": "twig", "markdown": "md markdown mdx", "txt": "txt", "rst": "rst", "pdf": "pdf", "docx": "docx", "vue": "vue", "svelte": "svelte", "razor": "cshtml razor",
        "objc": "m mm", "cuda": "cu cuh", "metal": "metal",
    }.items()
    for e in es.split()
}
FILE_LEVEL = frozenset(("yaml", "twig", "properties"))
DOCUMENTS = frozenset(("markdown", "txt", "rst"))
_OBJC_HEADER = re.compile(r"^\s*(?:@interface|@protocol|@property|#import)\b", re.M)
_CPP_HEADER = re.compile(r"^\s*(?:namespace\s+\w+|template\s*<|class\s+\w+|using\s+\w+|public:|private:)", re.M)


def detect_language(path: str, head: str = "") -> str | None:
    """By the last extension whatever its case; headers by what their first part says."""
    base = path.rsplit("/", 1)[-1].lower()
    if base.endswith(".blade.php"):
        return "php"
    ext = base.rsplit(".", 1)[-1] if "." in base else ""
    lang = EXTENSIONS.get(ext)
    if ext == "h" and head:
        part = head[:8192]
        lang = "objc" if _OBJC_HEADER.search(part) else "cpp" if _CPP_HEADER.search(part) else "c"
    return lang


def make_id(path: str, kind: str, name: str, line: int) -> str:
    return f"{kind}:{hashlib.sha256(f'{path}:{kind}:{name}:{line}'.encode()).hexdigest()[:32]}"


class Extraction(NamedTuple):
    nodes: list[dict]
    edges: list[dict]
    refs: list[dict]
    errors: list[str]


_CALL_SKIP = frozenset("if for while switch catch return function new typeof await super import with".split())
_CALL_SKIP_OF = {"go": frozenset("go defer select func".split()), "rust": frozenset("fn match loop in".split()), "java": frozenset("synchronized assert throw try".split())}
_IMPORTS = {
    "javascript": [re.compile(r"^\s*(?:import|export)\b(?:[^;'\"]*?\bfrom)?\s*['\"]([^'\"]+)['\"]", re.M), re.compile(r"\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)")],
    "go": [re.compile(r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([^\"\n]+)\"\s*$", re.M)],
    "java": [re.compile(r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", re.M)],
    "rust": [re.compile(r"^\s*(?:pub\s+)?use\s+([\w:{}*, \n]+?)\s*;", re.M)],
}
_IMPORTS["typescript"] = _IMPORTS["javascript"]


class _Out:
    def __init__(self, path: str, lang: str, text: str):
        self.path, self.lang = path, lang
        self.nodes: list[dict] = []
        self.edges: list[dict] = []
        self.refs: list[dict] = []
        self.file = f"file:{path}"
        n = text.count("\n") + 1
        self.nodes.append({"id": self.file, "kind": "file", "name": path.rsplit("/", 1)[-1], "qualified_name": path, "start_line": 1, "end_line": n, "docstring": None, "signature": None, "return_type": None, "decorators": [], "is_async": None, "is_static": None, "is_exported": None})

    def node(self, kind: str, name: str, qualified: str, start: int, end: int, owner: str, **more) -> str:
        i = make_id(self.path, kind, name, start)
        base = {"docstring": None, "signature": None, "return_type": None, "decorators": [], "is_async": None, "is_static": None, "is_exported": None}
        self.nodes.append(base | more | {"id": i, "kind": kind, "name": name, "qualified_name": qualified, "start_line": start, "end_line": end})
        self.edges.append({"source": owner, "target": i, "kind": "contains", "line": None})
        return i

    def ref(self, source: str, name: str, kind: str, line: int, column: int | None = None) -> None:
        self.refs.append({"from_node_id": source, "reference_name": name, "reference_kind": kind, "line": line, "column_no": column})


def _python(path: str, text: str, out: _Out) -> None:
    tree = python_tree(text)
    if not isinstance(tree, ast.AST):
        raise SyntaxError(str(tree))

    def dotted(x: ast.AST) -> str | None:
        if isinstance(x, ast.Name):
            return x.id
        if isinstance(x, ast.Attribute):
            a = dotted(x.value)
            return f"{a}.{x.attr}" if a else (f"{dotted(x.value.func)}().{x.attr}" if isinstance(x.value, ast.Call) and dotted(x.value.func) else None)
        return None

    work: list[tuple[ast.AST, str, tuple[str, ...], bool]] = [(tree, out.file, (), False)]
    while work:
        node, owner, scope, in_class = work.pop()
        for c in ast.iter_child_nodes(node):
            if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef)):
                a = c.args
                names = [x.arg for x in (*a.posonlyargs, *a.args)] + ([f"*{a.vararg.arg}"] if a.vararg else []) + [x.arg for x in a.kwonlyargs] + ([f"**{a.kwarg.arg}"] if a.kwarg else [])
                ret = ast.unparse(c.returns) if c.returns else None
                decs = [ast.unparse(d) for d in c.decorator_list]
                i = out.node("method" if in_class else "function", c.name, "::".join((*scope, c.name)), c.lineno, c.end_lineno, owner, docstring=ast.get_docstring(c), signature=f"({', '.join(names)})" + (f" -> {ret}" if ret else ""), return_type=ret, decorators=decs, is_async=isinstance(c, ast.AsyncFunctionDef), is_static=any("staticmethod" in d for d in decs))
                for d in c.decorator_list:
                    if isinstance(d, ast.Name):
                        out.ref(i, d.id, "decorates", d.lineno, d.col_offset)
                for x in [*a.posonlyargs, *a.args, *a.kwonlyargs]:
                    if x.annotation is not None and (t := dotted(x.annotation)):
                        out.ref(i, t, "type_of", x.lineno, x.col_offset)
                if c.returns is not None and (t := dotted(c.returns)):
                    out.ref(i, t, "returns", c.lineno, c.returns.col_offset)
                work.append((c, i, (*scope, c.name), False))
            elif isinstance(c, ast.ClassDef):
                i = out.node("class", c.name, "::".join((*scope, c.name)), c.lineno, c.end_lineno, owner, docstring=ast.get_docstring(c), decorators=[ast.unparse(d) for d in c.decorator_list])
                for b in c.bases:
                    if t := dotted(b):
                        out.ref(i, t, "extends", b.lineno, b.col_offset)
                work.append((c, i, (*scope, c.name), True))
            elif isinstance(c, ast.Import):
                for x in c.names:
                    i = out.node("import", x.name, x.name, c.lineno, c.end_lineno, owner, signature=ast.unparse(c))
                    out.ref(i, x.name, "imports", c.lineno, c.col_offset)
            elif isinstance(c, ast.ImportFrom):
                m = "." * c.level + (c.module or "")
                i = out.node("import", m, m, c.lineno, c.end_lineno, owner, signature=ast.unparse(c))
                for x in c.names:
                    if x.name != "*":
                        out.ref(i, x.asname or x.name, "imports", c.lineno, c.col_offset)
            else:
                if isinstance(c, ast.Call) and (t := dotted(c.func)):
                    out.ref(owner, t, "calls", c.lineno, c.col_offset)
                if isinstance(c, (ast.Assign, ast.AnnAssign)) and owner == out.file:
                    t = c.targets[0] if isinstance(c, ast.Assign) else c.target
                    if isinstance(t, ast.Name):
                        out.node("variable", t.id, t.id, c.lineno, c.end_lineno, owner)
                work.append((c, owner, scope, in_class and not isinstance(c, (ast.If, ast.Try, ast.With)) and False or (in_class and isinstance(c, (ast.If, ast.Try, ast.With)))))


def _scanned(path: str, lang: str, text: str, out: _Out) -> None:
    tokens = tokens_of(lang, text)
    if error := tokens.unread():
        raise SyntaxError(error)
    lines = comment_lines(text, tokens)
    scan = _Scan(lang, text, tokens, lines)
    found = [f for f in scan.run() if f.has_body]
    owner_of: dict[str, str] = {}
    spans: list[tuple[int, int, str]] = []
    for q, name, kind, first, last, bases in sorted(scan.types, key=lambda t: (t[3], -t[4])):
        if kind:
            up = q.rpartition("::")[0]
            i = out.node(kind, name, q, first, last, owner_of.get(up, out.file), docstring=lines.above(first), is_exported=_exported(lang, name, text, lines, first))
            owner_of.setdefault(q, i)
        for k, b in bases:
            out.ref(owner_of.get(q, out.file), b, k, first)
    types = set(owner_of)
    for f in found:
        up = f.qualified_name.rpartition("::")[0]
        i = out.node("method" if up and (up in types or lang in ("go", "rust") and up.count("::") == 0 and up not in {x.qualified_name for x in found}) else "function", f.name, f.qualified_name, f.start_line, f.end_line, owner_of.get(up, out.file), docstring=f.doc, signature=f.signature, is_async="async" in f.signature.split("(")[0].split(), is_static="static" in f.signature.split("(")[0].split(), is_exported=_exported(lang, f.name, text, lines, f.start_line))
        owner_of.setdefault(f.qualified_name, i)
        spans.append((f.start_line, f.end_line, i))
    for p in _IMPORTS.get(lang, ()):
        for m in p.finditer(text):
            line = lines.line(m.start(1))
            if lang == "go" and not re.match(r"\s*import\b", text[lines.starts[line - 1] : m.end()]) and not _in_import_block(text, m.start()):
                continue
            name = " ".join(m[1].split())
            i = out.node("import", name, name, line, line, out.file, signature=text[lines.starts[line - 1] : m.end()].strip())
            out.ref(i, name, "imports", line)
    heads: dict[str, list[int]] = {}
    for f in found:
        heads.setdefault(f.name, []).append(f.start_line)
    spans.sort(key=lambda x: (x[0], -x[1]))
    open_: list[tuple[int, str]] = []
    k = 0
    words, kinds = scan.word, scan.kind
    skip = _CALL_SKIP | _CALL_SKIP_OF.get(lang, frozenset())
    for j, w in enumerate(words):
        if kinds[j] != "w" or w in skip or scan.w(j + 1) != "(" or scan.w(j - 1) in ("function", "fn", "func", "class"):
            continue
        s = scan.start[j]
        line = lines.line(s)
        while k < len(spans) and spans[k][0] <= line:
            open_.append((spans[k][1], spans[k][2]))
            k += 1
        while open_ and open_[-1][0] < line:
            open_.pop()
        inside = [o for o in open_ if o[0] >= line]
        source = inside[-1][1] if inside else out.file
        a, name = j, w
        while a >= 2 and words[a - 1] in (".", "::", "?.") and kinds[a - 2] == "w":
            name = words[a - 2] + ("::" if words[a - 1] == "::" else ".") + name
            a -= 2
        close = scan.match.get(j + 1)
        if a == j and close is not None and any(x <= line <= x + 4 for x in heads.get(w, ())) and words[min(close + 1, scan.size - 1)] in ("{", ":", "->", "throws", "=>", "where"):
            continue  # the head of a definition
        out.ref(source, name, "instantiates" if a and words[a - 1] == "new" else "calls", line, s - lines.starts[line - 1])


def _in_import_block(text: str, at: int) -> bool:
    a = text.rfind("import (", 0, at)
    return a >= 0 and ")" not in text[a:at]


def _exported(lang: str, name: str, text: str, lines: _Lines, line: int) -> bool | None:
    head = text[lines.starts[line - 1] : lines.starts[line] if line < len(lines.starts) else len(text)]
    if lang == "go":
        return name[:1].isupper()
    return bool(re.match(r"\s*(?:export|pub|public)\b", head))


def nesting(text: str) -> int:
    depth = most = 0
    for c in re.findall(r"[(){}\[\]]", text):
        depth += 1 if c in "([{" else -1
        most = max(most, depth)
    return most


_EXTRACTORS: dict[str, Callable[[str, str, "_Out"], None]] = {}


def register_extractor(language: str, extractor: Callable[[str, str, "_Out"], None]) -> None:
    """``extractor(path, text, out)`` calls ``out.node`` and ``out.ref``."""
    _EXTRACTORS[language] = extractor


def extract_from_source(path: str, text: str, lang: str | None = None) -> Extraction:
    """Nodes, edges, references and diagnostics of one file."""
    lang = lang or detect_language(path, text)
    text = normalise(text)
    if lang is None:
        return Extraction([], [], [], ["unsupported_language"])
    if len(text.encode("utf-8", "surrogatepass")) > MAX_BYTES:
        return Extraction([], [], [], ["too_large"])
    out = _Out(path, lang, text)
    if lang in FILE_LEVEL:
        return Extraction([], [], [], [])
    try:
        if lang in DOCUMENTS:
            _document(path, lang, text, out)
        elif nesting(text) > MAX_NESTING:
            return Extraction(out.nodes, [], [], ["parse_error: nesting"])
        elif lang in _EXTRACTORS:
            _EXTRACTORS[lang](path, text, out)
        elif lang == "python":
            _python(path, text, out)
        elif lang in LANGUAGE_OF.values():
            _scanned(path, lang, text, out)
        else:
            return Extraction(out.nodes, [], [], ["unsupported_language"])
    except (SyntaxError, RecursionError) as x:
        return Extraction(out.nodes, [], [], [f"parse_error: {x}"])
    return Extraction(out.nodes, out.edges, out.refs, [])


# -- documents -------------------------------------------------------------------------------------------------------
def sections(lang: str, text: str) -> list[tuple[str, int, int, str]]:
    """``title, first line, last line, body``: headings of Markdown, underlined titles of reStructuredText."""
    rows = text.split("\n")
    heads: list[tuple[str, int, int]] = []
    fence = False
    if lang == "markdown":
        for i, row in enumerate(rows):
            if row.lstrip().startswith(("```", "~~~")):
                fence = not fence
            elif not fence and (m := re.match(r"#{1,6}\s+(.*?)\s*#*\s*$", row)):
                heads.append((m[1], i, i + 1))
    elif lang == "rst":
        for i in range(len(rows) - 1):
            title, under = rows[i].rstrip(), rows[i + 1].rstrip()
            if title.strip() and len(under) >= max(3, len(title)) and len(set(under)) == 1 and not under[0].isalnum() and not title[0].isspace() and len(set(title)) > 1:
                heads.append((title.strip(), i, i + 2))
    if not heads:
        return [(rows[0].strip()[:80] if rows else "", 1, len(rows), text)] if lang == "txt" and text.strip() else []
    out = []
    for n, (title, at, body) in enumerate(heads):
        end = heads[n + 1][1] if n + 1 < len(heads) else len(rows)
        out.append((title, at + 1, end, "\n".join(rows[body:end]).strip()))
    return out


def outward(text: str) -> list[tuple[str, str]]:
    """References of Markdown text: names in code spans, relative links, wiki links."""
    out = [(m, "doc_mention") for m in re.findall(r"(?<!`)`([^`\s]{2,128})`(?!`)", text)]
    for m in re.findall(r"\[[^\]\n]*\]\(([^)\s]+)\)", text):
        if "://" not in m and not m.startswith(("#", "mailto:")) and (p := m.removeprefix("./").split("#")[0]):
            out.append((p, "doc_path"))
    return out + [(m.strip(), "doc_link") for m in re.findall(r"\[\[([^\]\n|]+)(?:\|[^\]\n]*)?\]\]", text)]


def _document(path: str, lang: str, text: str, out: _Out) -> None:
    base = path.rsplit("/", 1)[-1]
    doc = out.node("document", base, path, 1, text.count("\n") + 1, out.file)
    for title, first, last, body in sections(lang, text):
        cut = body.encode()[:MAX_SECTION].decode(errors="ignore")
        i = out.node("section", title, f"{path}::{title}", first, last, doc, docstring=cut)
        if lang == "markdown":
            for name, kind in outward(body):
                out.ref(i, name, kind, first)


def docx_text(data: bytes, limit: int = 512 * 1024) -> str:
    """The text of a Word document."""
    import io
    import zipfile
    from xml.etree import ElementTree

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))
    return "\n".join(paragraphs).encode()[:limit].decode(errors="ignore")


# -- distributed -----------------------------------------------------------------------------------------------------
_ROW = (
    "row_type string, path string, language string, id string, kind string, name string, qualified_name string, start_line int, end_line int, docstring string, signature string, return_type string, decorators array<string>,"
    " is_async boolean, is_static boolean, is_exported boolean, source string, target string, reference_name string, reference_kind string, line int, column_no int, error string"
)
_COLUMNS = [c.strip().split()[0] for c in _ROW.split(",")]


def _rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows: list[dict] = []
        for path, text in zip(part["path"], part["text"]):
            lang = detect_language(path, text)
            x = extract_from_source(path, text, lang)
            base = {"path": path, "language": lang}
            rows.append(base | {"row_type": "file", "error": "; ".join(x.errors) or None, "start_line": len(x.nodes)})
            rows += [base | {"row_type": "node"} | n for n in x.nodes]
            rows += [base | {"row_type": "edge"} | e for e in x.edges]
            rows += [base | {"row_type": "ref", "source": r["from_node_id"], **{k: r[k] for k in ("reference_name", "reference_kind", "line", "column_no")}} for r in x.refs]
        df = pd.DataFrame(rows, columns=_COLUMNS)
        for c in df.columns:
            df[c] = df[c].astype("Int32") if c in ("start_line", "end_line", "line", "column_no") else df[c].astype(object).where(df[c].notna(), None)
        yield df


class Extracted(NamedTuple):
    nodes: DataFrame
    edges: DataFrame
    refs: DataFrame
    files: DataFrame


def extract(files: DataFrame) -> Extracted:
    """Tables of all files (``path, text``); the union is written once."""
    rows = checkpoint(widen(files.filter("path IS NOT NULL AND text IS NOT NULL").select("path", "text")).mapInPandas(_rows, _ROW))
    node = rows.filter("row_type = 'node'").select("id", "kind", "name", "qualified_name", F.col("path").alias("file_path"), "language", "start_line", "end_line", "docstring", "signature", "return_type", "decorators", "is_async", "is_static", "is_exported")
    edge = rows.filter("row_type = 'edge'").select("source", "target", "kind", "line")
    ref = rows.filter("row_type = 'ref'").select(F.col("source").alias("from_node_id"), "reference_name", "reference_kind", "line", "column_no", F.col("path").alias("file_path"), "language")
    file = rows.filter("row_type = 'file'").select("path", "language", F.col("start_line").alias("node_count"), "error")
    return Extracted(node, edge, ref, file)


def markdown_sections(texts: DataFrame) -> DataFrame:
    """``doc_id, section, title, lines``: sections of Markdown without Python: lines are numbered by their headings."""
    from pyspark.sql import Window as W

    rows = texts.select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("n", "row"))
    order = W.partitionBy("doc_id").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    fence = F.sum(F.col("row").rlike(r"^\s*(?:```|~~~)").cast("int")).over(order) % 2
    head = F.col("row").rlike(r"^#{1,6}\s+\S") & (F.col("fence") == 0)
    at = rows.withColumn("fence", fence).withColumn("head", head).withColumn("section", F.sum(F.col("head").cast("int")).over(order)).filter("section > 0")
    title = F.max(F.when(F.col("head"), F.regexp_replace(F.regexp_replace("row", r"^#{1,6}\s+", ""), r"\s*#*\s*$", "")))
    return at.groupBy("doc_id", "section").agg(title.alias("title"), F.count(F.lit(1)).alias("lines"))
