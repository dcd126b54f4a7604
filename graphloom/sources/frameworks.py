"""Routes of web frameworks, found in source text: route nodes and references to their handlers.

Comments are blanked first, character by character, so lines stay where they are and routes in comments vanish (the
two frameworks whose routes are read from raw text are marked). Each framework is one entry of ``FRAMEWORKS``; more can
be registered.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..session import widen
from .extract import detect_language, make_id
from .lexing import LANGUAGE_OF, lex

Route = tuple[str, str, str | None, str, int]  # method, path, handler, kind of reference, offset
FRAMEWORKS: dict[str, tuple[frozenset[str], bool, Callable[[str, str], Iterator[Route]]]] = {}
_VERBS = "get|post|put|delete|patch|head|options|all"


def register_framework(name: str, languages: str, scan: Callable[[str, str], Iterator[Route]], raw: bool = False) -> None:
    FRAMEWORKS[name] = (frozenset(languages.split()), raw, scan)


def blank_comments(lang: str, text: str) -> str:
    """The text with comments as blanks; line ends stay."""
    if lang in LANGUAGE_OF.values():
        tokens, _ = lex(lang, text)
        parts, at = [], 0
        for k, s, e in tokens:
            if k == "c":
                parts += [text[at:s], re.sub(r"[^\n]", " ", text[s:e])]
                at = e
        return "".join([*parts, text[at:]])
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    if lang == "ruby":
        return re.sub(r"(?m)(?<!['\"\w])#[^\n{]*$", blank, text)
    return re.sub(r"/\*[\s\S]*?\*/|(?<![:'\"])//[^\n]*", blank, text)


def _delimited(text: str, at: int) -> int:
    """The end of the bracket that opens at ``at``; strings are skipped."""
    depth, i = 0, at
    while i < len(text):
        c = text[i]
        if c in "'\"`":
            j = i + 1
            while j < len(text) and text[j] != c:
                j += 1 + (text[j] == "\\")
            i = j
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                return i
        i += 1
    return len(text)


def _arguments(text: str, at: int) -> list[str]:
    """The arguments of a call whose bracket opens at ``at``."""
    end, out, depth, start, i = _delimited(text, at), [], 0, at + 1, at + 1
    while i < end:
        c = text[i]
        if c in "'\"`":
            j = i + 1
            while j < end and text[j] != c:
                j += 1 + (text[j] == "\\")
            i = j
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "," and not depth:
            out.append(text[start:i].strip())
            start = i + 1
        i += 1
    last = text[start:end].strip()
    return [*out, last] if last else out


def _handler(arg: str) -> str | None:
    return arg if re.fullmatch(r"[A-Za-z_$][\w$]*(?:(?:\.|::)[A-Za-z_$][\w$]*)*", arg) else None


def _express(path: str, text: str) -> Iterator[Route]:
    for m in re.finditer(rf"\b(?:app|router|\w+Router)\.({_VERBS}|use)(\()\s*(['\"`])([^'\"`]*)\3", text):
        if m[1] == "use" and not m[4].startswith("/"):
            continue
        args = _arguments(text, m.start(2))
        last = args[-1] if len(args) > 1 else ""
        if "=>" in last or last.startswith(("function", "async")):
            body = last[last.find("=>") + 2 if "=>" in last else last.find("{") :]
            skip = {"if", "for", "while", "switch", "catch", "return", "await", "function", "async", "json", "send", "status", "next", "end", "render", "redirect"}
            names = sorted(set(re.findall(r"\b([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*\(", body)))
            hit = False
            for n in names:
                if n.split(".")[-1] not in skip and n.split(".")[0] not in ("res", "req", "response", "request", "console", "JSON"):
                    hit = True
                    yield m[1].upper(), m[4], n, "calls", m.start()
            if not hit:
                yield m[1].upper(), m[4], None, "references", m.start()
        else:
            yield m[1].upper(), m[4], _handler(last), "references", m.start()


def _react(path: str, text: str) -> Iterator[Route]:
    for m in re.finditer(r"<Route\b([^>]{0,400}?)/?>", text, re.S):
        p = re.search(r"\bpath=\{?['\"]([^'\"]*)['\"]", m[1])
        c = re.search(r"\b(?:component|element)=\{\s*<?\s*([A-Z]\w*)", m[1])
        if p:
            yield "ANY", p[1], c[1] if c else None, "references", m.start()
    if re.search(r"\bcreate\w*Router\(|\buseRoutes\(", text):
        for m in re.finditer(r"\bpath:\s*['\"]([^'\"]*)['\"][^{}]{0,200}?\b(?:element|Component):\s*<?\s*([A-Z]\w*)", text):
            yield "ANY", m[1], m[2], "references", m.start()
    page = re.search(r"(?:^|/)pages/(.+)\.[jt]sx?$", path) or re.search(r"(?:^|/)app/(.*?)/?page\.[jt]sx?$", path)
    if page and re.search(r"\bexport\s+default\b", text):
        route = "/" + re.sub(r"(?:^|/)index$", "", page[1])
        d = re.search(r"\bexport\s+default\s+(?:async\s+)?(?:function|class)?\s*([A-Z]\w*)", text)
        yield "ANY", route, d[1] if d else None, "references", 0


def _django(path: str, text: str) -> Iterator[Route]:
    for m in re.finditer(r"\b(?:path|re_path|url)(\()\s*r?(['\"])([^'\"]*)\2", text):
        args = _arguments(text, m.start(1))
        view = args[1] if len(args) > 1 else ""
        if i := re.match(r"include\(\s*['\"]([\w.]+)['\"]", view):
            yield "", m[3], i[1], "imports", m.start()
        else:
            name = re.sub(r"\.as_view\(.*\)$", "", view, flags=re.S)
            yield "", m[3], name.split(".")[-1] if _handler(name) else None, "references", m.start()
    for m in re.finditer(r"\.register\(\s*r?['\"]([^'\"]*)['\"]\s*,\s*([\w.]*(?:ViewSet|View))\b", text):
        yield "VIEWSET", m[1].strip("^$/"), m[2].split(".")[-1], "references", m.start()


def _next_def(text: str, at: int) -> str | None:
    m = re.compile(r"\s*(?:@[^\n]*(?:\n(?!\s*(?:async\s+)?def\b|\s*@)[^\n]*)*\n\s*)*(?:async\s+)?def\s+(\w+)").match(text, at)
    return m[1] if m else None


def _flask(path: str, text: str) -> Iterator[Route]:
    for m in re.finditer(r"^[ \t]*@(\w+)\.route(\()", text, re.M):
        args = _arguments(text, m.start(2))
        p = re.match(r"r?['\"]([^'\"]*)['\"]", args[0] if args else "")
        methods = next((re.findall(r"['\"](\w+)['\"]", a) for a in args if a.startswith("methods")), [])
        yield (methods or ["GET"])[0].upper(), (p[1] if p else "") or "/", _next_def(text, _delimited(text, m.start(2)) + 1), "references", m.start()
    for m in re.finditer(r"\.add_resource(\()", text):
        args = _arguments(text, m.start(1))
        for a in args[1:]:
            if p := re.fullmatch(r"r?['\"]([^'\"]*)['\"]", a):
                yield "ANY", p[1], _handler(args[0]), "references", m.start()


def _fastapi(path: str, text: str) -> Iterator[Route]:
    for m in re.finditer(r"^[ \t]*@(\w+)\.(get|post|put|delete|patch|head|options)(\()\s*(?:path\s*=\s*)?['\"]([^'\"]*)['\"]", text, re.M):
        yield m[2].upper(), m[4] or "/", _next_def(text, _delimited(text, m.start(3)) + 1), "references", m.start()


def _joined(prefix: str, sub: str) -> str:
    return "/" + "/".join(x.strip("/") for x in (prefix, sub) if x.strip("/"))


def _spring(path: str, text: str) -> Iterator[Route]:
    value = r"(?:\(\s*(?:(?:value|path)\s*=\s*)?\{?\s*\"([^\"]*)\"[^)]*\)|\(\s*\)|(?=\s))"
    top = re.search(rf"@RequestMapping{value}(?:\s|@\w+(?:\([^)]*\))?|public|abstract|final)*\b(?:class|interface)\b", text)
    prefix = (top[1] or "") if top else ""
    method = r"(?:\s|@\w+(?:\([^)]*\))?)*(?:public|protected|private|static|final|\s)*[\w<>\[\], ?]+\s+(\w+)\s*\("
    for m in re.finditer(rf"@(Get|Post|Put|Delete|Patch)Mapping{value}{method}", text):
        yield m[1].upper(), _joined(prefix, m[2] or ""), m[3], "references", m.start()
    for m in re.finditer(r"@RequestMapping\(([^)]*)\)" + method, text):
        if top and m.start() == top.start():
            continue
        p, v = re.search(r"\"([^\"]*)\"", m[1]), re.search(r"RequestMethod\.(\w+)", m[1])
        yield v[1] if v else "ANY", _joined(prefix, p[1] if p else ""), m[2], "references", m.start()


def _go(path: str, text: str) -> Iterator[Route]:
    for m in re.finditer(r"\b\w+\.(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|Any|Get|Post|Put|Delete|Patch|Handle|HandleFunc)(\()\s*\"([^\"]*)\"\s*,", text):
        args = _arguments(text, m.start(2))
        yield "ANY" if m[1] in ("Any", "Handle", "HandleFunc") else m[1].upper(), m[3], _handler(args[-1]), "references", m.start()


def _rust(path: str, text: str) -> Iterator[Route]:
    for m in re.finditer(r"#\[(get|post|put|delete|patch|head|options)\(\s*\"([^\"]*)\"[^\]]*\)\]", text):
        f = re.compile(r"(?:\s|#\[[^\]]*\]|pub(?:\([^)]*\))?|async|unsafe)*fn\s+(\w+)").match(text, m.end())
        yield m[1].upper(), m[2], f[1] if f else None, "references", m.start()
    for m in re.finditer(r"\.route(\()\s*\"([^\"]*)\"\s*,", text):
        rest = text[m.end() : _delimited(text, m.start(1))]
        for v in re.finditer(r"\b(get|post|put|delete|patch|head|options|any)\(\s*([^()]*(?:\([^()]*\))?[^()]*)\)", rest):
            yield v[1].upper(), m[2], _handler(v[2].strip()), "references", m.start()


def _laravel(path: str, text: str) -> Iterator[Route]:
    for m in re.finditer(rf"\bRoute::({_VERBS}|any)(\()\s*['\"]([^'\"]*)['\"]\s*,", text):
        args = _arguments(text, m.start(2))
        h = args[1] if len(args) > 1 else ""
        t = re.match(r"\[\s*([\w\\]+)::class\s*,\s*['\"](\w+)['\"]", h)
        s = re.fullmatch(r"['\"]([\w\\]+)@(\w+)['\"]", h)
        c = re.fullmatch(r"([\w\\]+)::class", h)
        name = f"{t[1]}@{t[2]}" if t else f"{s[1]}@{s[2]}" if s else c[1] if c else None
        yield m[1].upper(), m[3], name.split("\\")[-1] if name else None, "references", m.start()
    for m in re.finditer(r"\bRoute::(?:apiR|r)esource\(\s*['\"]([^'\"]*)['\"]\s*,\s*([\w\\]+)::class", text):
        yield "RESOURCE", f"resource:{m[1]}", m[2].split("\\")[-1], "imports", m.start()


def _rails(path: str, text: str) -> Iterator[Route]:
    for m in re.finditer(r"^\s*(get|post|put|patch|delete)\s+['\"]([^'\"]*)['\"]\s*,\s*(?:to:|=>)\s*['\"]([\w/]+#\w+)['\"]", text, re.M):
        yield m[1].upper(), m[2], m[3], "references", m.start()
    many = (("index", "GET", ""), ("new", "GET", "/new"), ("create", "POST", ""), ("show", "GET", "/:id"), ("edit", "GET", "/:id/edit"), ("update", "PATCH", "/:id"), ("destroy", "DELETE", "/:id"))
    for m in re.finditer(r"^\s*(resources?)\s+:(\w+)([^\n]*)", text, re.M):
        only = re.search(r"\bonly:\s*(\[[^\]]*\]|:\w+|%i\[[^\]]*\])", m[3])
        out = re.search(r"\bexcept:\s*(\[[^\]]*\]|:\w+|%i\[[^\]]*\])", m[3])
        keep = set(re.findall(r"\w+", only[1])) - {"i"} if only else {a for a, _, _ in many} - (set(re.findall(r"\w+", out[1])) if out else set())
        one = m[1] == "resource"
        for action, verb, tail in many:
            if action in keep and not (one and action == "index"):
                yield verb, f"/{m[2]}{tail.replace('/:id', '') if one else tail}", f"{m[2] + 's' if one else m[2]}#{action}", "references", m.start()


def _aspnet(path: str, text: str) -> Iterator[Route]:
    top = re.search(r"\[Route\(\s*\"([^\"]*)\"\s*\)\](?:\s|\[[^\]]*\]|public|sealed|abstract|partial)*class\s+(\w+)", text)
    prefix = top[1].replace("[controller]", top[2].removesuffix("Controller").lower()) if top else ""
    for m in re.finditer(r"\[Http(Get|Post|Put|Delete|Patch)(?:\(\s*\"([^\"]*)\"[^\]]*\)|\(\s*\))?\](?:\s|\[[^\]]*\])*(?:public|private|protected|async|static|virtual|override|\s)*[\w<>\[\], ?]+\s+(\w+)\s*\(", text):
        yield m[1].upper(), _joined(prefix, m[2] or ""), m[3], "references", m.start()
    for m in re.finditer(r"\.Map(Get|Post|Put|Delete|Patch)(\()\s*\"([^\"]*)\"\s*,", text):
        args = _arguments(text, m.start(2))
        h = _handler(args[-1])
        yield m[1].upper(), m[3], h.split(".")[-1] if h else None, "references", m.start()


for _n, _l, _f, _r in (
    ("express", "javascript typescript", _express, False), ("react", "javascript typescript jsx tsx", _react, True), ("django", "python", _django, False), ("flask", "python", _flask, False),
    ("fastapi", "python", _fastapi, False), ("spring", "java kotlin", _spring, True), ("go", "go", _go, False), ("rust", "rust", _rust, False), ("laravel", "php", _laravel, False),
    ("rails", "ruby", _rails, False), ("aspnet", "csharp", _aspnet, False),
):
    register_framework(_n, _l, _f, _r)


def config_keys(path: str, text: str) -> list[tuple[str, int]]:
    """Leaf keys of YAML or properties text with their lines; values are not kept."""
    out: list[tuple[str, int]] = []
    if path.endswith(".properties"):
        for i, row in enumerate(text.split("\n"), 1):
            if m := re.match(r"\s*([^#!\s=:][^\s=:]*)\s*[=:]", row):
                out.append((m[1], i))
        return out
    stack: list[tuple[int, str]] = []
    for i, row in enumerate(text.split("\n"), 1):
        m = re.match(r"( *)([\w.-]+):(?:\s+(.*))?$", row)
        if not m:
            continue
        while stack and stack[-1][0] >= len(m[1]):
            stack.pop()
        key = ".".join([*(k for _, k in stack), m[2]])
        if m[3] and not m[3].startswith("#"):
            out.append((key, i))
        else:
            stack.append((len(m[1]), m[2]))
    return out


def file_routes(path: str, text: str) -> list[dict]:
    """All routes of a file, in order."""
    lang = detect_language(path, text)
    out = []
    clean = None
    for name, (langs, raw, scan) in FRAMEWORKS.items():
        if lang not in langs:
            continue
        if not raw and clean is None:
            clean = blank_comments(lang, text)
        source = text if raw else clean
        for method, route, handler, kind, at in scan(path, source):
            line = source.count("\n", 0, at) + 1
            label = f"{method} {route}".strip()
            out.append({"framework": name, "file_path": path, "language": lang, "method": method, "route_path": route, "handler": handler, "reference_kind": kind, "line": line, "route_id": make_id(path, "route", label, line), "name": label})
    return sorted(out, key=lambda r: (r["line"], r["name"], r["handler"] or ""))


_ROUTE = "framework string, file_path string, language string, method string, route_path string, handler string, reference_kind string, line int, route_id string, name string"


def routes(files: DataFrame) -> DataFrame:
    """Routes of all files (``path, text``), one row for each handler."""

    def run(parts):
        for p in parts:
            yield pd.DataFrame([r for path, text in zip(p["path"], p["text"]) for r in file_routes(path, text)], columns=[c.split()[0] for c in _ROUTE.split(", ")])

    return widen(files.filter("path IS NOT NULL AND text IS NOT NULL").select("path", "text")).mapInPandas(run, _ROUTE)


def route_nodes(found: DataFrame) -> DataFrame:
    """Nodes of kind route: ``id, kind, name, qualified_name, file_path, language, start_line, route_method, route_path, framework``."""
    from pyspark.sql import functions as F

    return found.select(
        F.col("route_id").alias("id"), F.lit("route").alias("kind"), "name", F.col("name").alias("qualified_name"), "file_path", "language", F.col("line").alias("start_line"),
        F.when(F.col("method") != "", F.col("method")).alias("route_method"), "route_path", "framework",
    ).distinct()
