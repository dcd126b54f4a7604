"""Functions and methods of a source text with the comments that document them; one pass over its tokens."""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from itertools import accumulate, compress, repeat
from typing import NamedTuple

from .lexing import Tokens, normalise, tokens_of


class Function(NamedTuple):
    """``start`` and ``end``: its place in the normalised text; ``types``: its parameters' types and its result's, without
    blanks, qualifiers and names, by which overloads are told apart; ``has_body``: false for mere declarations."""

    qualified_name: str
    name: str
    signature: str
    params: int
    types: str
    start_line: int
    end_line: int
    start: int
    end: int
    doc: str | None
    has_body: bool


class _Lines:
    """Line numbers (from 1) and the comment that ends on a given line. ``comments``: first and last places, in order."""

    def __init__(self, text: str, comments: list[tuple[int, int]]):
        self.text = text
        self.starts = list(accumulate(map((1).__add__, map(len, text.split("\n"))), initial=0))[:-1]
        self.comments, self.ends = comments, [e for _, e in comments]

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def ending(self, line: int) -> int | None:
        """The last comment that ends on the line and has nothing before it on its first line."""
        if line < 1:
            return None
        at, text = self.starts[line - 1], self.text
        i = bisect_right(self.ends, self.starts[line] if line < len(self.starts) else len(text)) - 1
        while i >= 0 and self.ends[i] > at:
            s = self.comments[i][0]
            if not text[text.rfind("\n", 0, s) + 1 : s].strip():
                return i
            i -= 1
        return None

    def above(self, line: int) -> str | None:
        """The comment that ends on the line before; line comments one below the other are one comment."""
        i = self.ending(line - 1)
        if i is None:
            return None
        text, (s, _) = self.text, self.comments[i]
        while text[s : s + 2] != "/*" and (up := self.ending(self.line(s) - 1)) is not None and text[self.comments[up][0] : self.comments[up][0] + 2] != "/*":
            s = self.comments[up][0]
        return text[s : self.starts[line - 1]]


def functions(lang: str, text: str) -> list[Function]:
    """All named functions of a valid text that have a body, in order."""
    return [f for f in declarations(lang, text)[0] if f.has_body]


def declarations(lang: str, text: str) -> tuple[list[Function], list[tuple[str, str]]]:
    """All named functions of a valid text, also those without a body, in order; and ``(type, base)`` of its types."""
    source = normalise(text)
    tokens = tokens_of(lang, source)
    lines = comment_lines(source, tokens)
    if lang == "python":
        return _Python(source, tokens, lines).run()
    scan = _Scan(lang, source, tokens, lines)
    return scan.run(), [(q, b) for q, _, _, _, _, bases in scan.types for _, b in bases]


def comment_lines(source: str, tokens: Tokens) -> _Lines:
    starts, words = tokens.starts, tokens.words
    places = [m.start() for m in re.finditer("c", tokens.kinds)]
    return _Lines(source, [(starts[i], starts[i] + len(words[i])) for i in places])


class _Block(NamedTuple):
    """A definition of Python whose suite is open: its indentation and name, and what its function is made of."""

    indent: int
    name: str
    made: tuple | None


class _Python:
    """Definitions by logical lines: brackets folded, suites by indentation."""

    def __init__(self, source: str, tokens: Tokens, lines: _Lines):
        self.source, self.lines, self.words, self.kinds = source, lines, tokens.words, tokens.kinds
        self.starts, self.end = tokens.starts, tokens.end
        self.out: list[Function] = []
        self.bases: list[tuple[str, str]] = []
        self.open: list[_Block] = []
        #: The definition whose documentation may come next, first token of the decorators, end of the last statement.
        self.wants: list[str] | None = None
        self.decorators: int | None = None
        self.last = 0

    def run(self) -> tuple[list[Function], list[tuple[str, str]]]:
        words, kinds, depth, at = self.words, self.kinds, 0, 0
        width = len(self.source[: self.starts[0]].replace("\f", "").expandtabs(8)) if words else 0
        for m in _PY_MARKS.finditer(kinds):
            i = m.start()
            if kinds[i] == "p":
                depth += (words[i] in _OPEN) - (words[i] in _CLOSE)
            elif depth <= 0:
                self._line(at, i, width)
                at, width = i + 1, len(words[i][1:].replace("\f", "").expandtabs(8))
        self._line(at, len(words), width)
        self._close(-1)
        return sorted(self.out, key=lambda f: (f.start_line, f.qualified_name)), self.bases

    def _close(self, width: int) -> None:
        while self.open and self.open[-1].indent >= width:
            made = self.open.pop().made
            if made:
                self._add(*made, self.last)

    def _line(self, a: int, b: int, width: int) -> None:
        kinds, words = self.kinds, self.words
        while a < b and kinds[a] in "cx":
            a += 1
        while b > a and kinds[b - 1] in "cx":
            b -= 1
        if a >= b:
            return
        wants, self.wants = self.wants, None
        if wants is not None and width > self.open[-1].indent and kinds[a] == "s":
            wants.append(self._docstring(a, b))
        self._close(width)
        w = words[a]
        if w == "@":
            self.decorators = a if self.decorators is None else self.decorators
        else:
            first, self.decorators = a if self.decorators is None else self.decorators, None
            if w == "def" or w == "async" and a + 1 < b and words[a + 1] == "def":
                self._def(a, b, width, first)
            elif w == "class" and a + 1 < b:
                colon = self._colon(a + 2, b)
                scope = "::".join([*(x.name for x in self.open), words[a + 1]])
                self.bases += [(scope, x) for x in self._named(a + 2, colon)]
                self.open.append(_Block(width, words[a + 1], None))
                if colon + 1 < b:
                    self._bound(colon + 1, b)
            else:
                self._bound(a, b)
        self.last = self.end(b - 1)

    def _bound(self, a: int, b: int) -> None:
        """``name = lambda ...``, also annotated."""
        words = self.words
        if self.kinds[a] != "w" or a + 1 >= b or words[a + 1] not in ("=", ":") or "lambda" not in words[a:b]:
            return
        at = words.index("lambda", a, b)
        depth = 0
        for i in range(a, at):
            depth += (words[i] in "([{") - (words[i] in ")]}")
        if depth or words[at - 1] != "=" or any(w not in ("=", ":", ".", ",", "|") and self.kinds[i] != "w" and w not in "[]" for i, w in enumerate(words[a:at], a)):
            return
        colon = self._colon(at + 1, b)
        stop, i = b, colon + 1
        while i < b:
            depth += (words[i] in "([{") - (words[i] in ")]}")
            if not depth and words[i] in (",", ";"):
                if words[i] == ",":
                    return
                stop = i
                break
            i += 1
        self._add(words[a], tuple(x.name for x in self.open), a, a, None, self._parameters(at + 1, colon), b, self.end(stop - 1))

    def _def(self, a: int, b: int, width: int, first: int) -> None:
        words = self.words
        at = a + 2 if words[a] == "async" else a + 1
        if "(" not in words[at + 1 : b]:
            return  # a damaged head
        colon = self._colon(at + 1, b)
        paren = words.index("(", at + 1) if words[at + 1] != "[" else self._close_of(at + 1) + 1
        doc: list[str] = []
        made = (words[at], tuple(x.name for x in self.open), a, first, doc, self._parameters(paren + 1, self._close_of(paren)), colon)
        self.open.append(_Block(width, words[at], made))
        if colon + 1 < b:
            if self.kinds[colon + 1] == "s":
                doc.append(self._docstring(colon + 1, b))
        else:
            self.wants = doc

    def _colon(self, a: int, b: int) -> int:
        """The colon that ends a head."""
        depth, words = 0, self.words
        for i in range(a, b):
            w = words[i]
            depth += (w in _OPEN) - (w in _CLOSE)
            if w == ":" and not depth:
                return i
        return b

    def _close_of(self, a: int) -> int:
        depth = 0
        for i in range(a, len(self.words)):
            w = self.words[i]
            depth += (w in _OPEN) - (w in _CLOSE)
            if not depth:
                return i
        return len(self.words)

    def _parts(self, a: int, b: int) -> list[list[int]]:
        out, depth = [[]], 0
        for i in range(a, b):
            w = self.words[i]
            if self.kinds[i] in "lcx":
                continue
            depth += (w in _OPEN) - (w in _CLOSE)
            if w == "," and not depth:
                out.append([])
            else:
                out[-1].append(i)
        return [x for x in out if x]

    def _parameters(self, a: int, b: int) -> int:
        return sum(self.words[x[0]] not in ("*", "**", "/") for x in self._parts(a, b))

    def _named(self, a: int, b: int) -> list[str]:
        """Names in a list of bases."""
        open_ = next((i for i in range(a, b) if self.words[i] == "("), None)
        if open_ is None:
            return []
        parts = self._parts(open_ + 1, self._close_of(open_))
        return [self.words[x[-1]] for x in parts if all(self.kinds[i] == "w" if n % 2 == 0 else self.words[i] == "." for n, i in enumerate(x)) and len(x) % 2]

    def _docstring(self, a: int, b: int) -> str:
        """The value of a statement that is nothing but string literals, else nothing."""
        parts = []
        for i in range(a, b):
            if self.words[i] == ";":
                break
            if self.kinds[i] in "lcx":
                continue
            if self.kinds[i] != "s" or set(re.match(r"\w*", self.words[i])[0].lower()) & set("bft"):
                return ""
            parts.append(self.words[i])
        if len(parts) == 1 and parts[0][:3] in ('"""', "'''") and "\\" not in parts[0]:
            return parts[0][3:-3]
        try:
            return "".join(map(ast.literal_eval, parts))
        except (SyntaxError, ValueError):
            return ""

    def _add(self, name: str, scope: tuple[str, ...], at: int, first: int, doc: list[str] | None, params: int, colon: int, end: int) -> None:
        lines, starts = self.lines, self.lines.starts
        line, top = lines.line(self.starts[at]), lines.line(self.starts[first])
        above = lines.above(line)
        if top < line:
            above = above or lines.above(top)
        both = "\n".join(x for x in (above, *(doc or ())) if x)
        last = lines.line(end - 1)
        stop = starts[last] - 1 if last < len(starts) else len(self.source)
        sig = " ".join(self.source[self.starts[at] : self.end(colon - 1) if doc is not None else end].split())
        self.out.append(Function("::".join((*scope, name)), name, sig, params, str(params), top, last, starts[top - 1], stop, both or None, True))


#: Words that something can begin with.
_BEGINS = {
    "javascript": frozenset("function class =>".split()),
    "typescript": frozenset("function class interface namespace =>".split()),
    "go": frozenset("type func".split()),
    "java": frozenset("class interface enum record new ->".split()),
    "rust": frozenset("fn impl trait mod struct enum let".split()),
}
_OPEN, _CLOSE = frozenset("([{") | {"${"}, frozenset(")]}")
#: A letter for each token that matters: ``o`` and ``O`` opening brackets, ``c`` closing ones, ``b`` beginnings, ``<`` what
#: may follow a method's name.
_CODES = {lang: {**dict.fromkeys("<?", 60), **dict.fromkeys(("[", "{", "${"), 79), "(": 111, **dict.fromkeys(")]}", 99), **dict.fromkeys(own, 98)} for lang, own in _BEGINS.items()}
_BRACKETS = re.compile(b"[oOc]")
_CANDIDATES = {"java": re.compile(rb"[oOb]|.(?=o)", re.S), "go": re.compile(b"[oOb]"), "rust": re.compile(b"[oOb]")}
_CANDIDATES["javascript"] = _CANDIDATES["typescript"] = re.compile(rb"[oOb]|.(?=[o<])", re.S)
_PY_MARKS = re.compile("[pl]")
_IS_CODE = bytes(chr(i) not in "clte" for i in range(256))
_JS_NOT_METHOD = frozenset("if for while switch catch with return function new typeof await super import".split())
_JS_MODIFIERS = frozenset("public private protected static readonly abstract override async declare get set accessor export default".split())
_JAVA_MODIFIERS = frozenset("public private protected static final abstract native synchronized default strictfp transient volatile sealed".split())
#: What a type's spelling does not count.
_TYPE_NOISE = frozenset("readonly final dyn mut const struct".split())
_RUST_HEAD = frozenset("pub async unsafe const extern default crate in".split())


class _Scan:
    """Scopes by brackets; what a name before a bracket means depends on the language and the scope."""

    def __init__(self, lang: str, text: str, tokens: Tokens, lines: _Lines):
        self.lang, self.text, self.lines = lang, text, lines
        kinds = tokens.kinds.encode()
        code = kinds.translate(_IS_CODE)
        #: Texts, first places and kinds of the tokens but comments, line ends and templates' texts.
        self.word, self.start = (list(compress(x, code)) for x in (tokens.words, tokens.starts))
        self.kind = kinds.translate(None, b"clte").decode()
        self.size = len(self.word)
        self.codes = bytes(map(_CODES[lang].get, self.word, repeat(46)))
        self.match = self._match()
        self.out: list[Function] = []
        #: Declared types: qualified name, name, kind, first and last line, names of the bases.
        self.types: list[tuple[str, str, str, int, int, list[tuple[str, str]]]] = []

    def _match(self) -> dict[int, int]:
        stack, match = [], {}
        for m in _BRACKETS.finditer(self.codes):
            i = m.start()
            if self.codes[i] != 99:
                stack.append(i)
            elif stack:
                j = stack.pop()
                match[j], match[i] = i, j
        return match

    def run(self) -> list[Function]:
        body = {"javascript": self._ecma, "typescript": self._ecma, "go": self._go, "java": self._java, "rust": self._rust}[self.lang]
        #: scope opened by the bracket at an index: (names, kind)
        self.scope: dict[int, tuple[tuple[str, ...], str]] = {}
        match, scope, words, kinds, codes = self.match, self.scope, self.word, self.kind, self.codes
        stack: list[tuple[int, tuple[str, ...], str]] = [(self.size, (), "top")]
        end, names, kind = stack[-1]
        for m in _CANDIDATES[self.lang].finditer(codes):
            i = m.start()
            while end <= i and len(stack) > 1:
                stack.pop()
                end, names, kind = stack[-1]
            if codes[i] | 32 == 111 and i in match:
                names, kind = scope.get(i, (names, "block" if kind in ("class", "object") and words[i] == "{" else "code"))
                end = match[i]
                stack.append((end, names, kind))
            else:
                body(i, kinds[i], words[i], names, kind)
        return sorted(self.out, key=lambda f: (f.start_line, f.qualified_name))

    # -- help ------------------------------------------------------------------------------------------------------
    def w(self, i: int) -> str:
        return self.word[i] if 0 <= i < self.size else ""

    def k(self, i: int) -> str:
        return self.kind[i] if 0 <= i < self.size else ""

    def end(self, i: int) -> int:
        return self.start[i] + len(self.word[i])

    def line(self, i: int) -> int:
        return self.lines.line(self.start[i])

    def angle(self, i: int) -> int:
        """After type parameters that start at ``i``, or ``i``."""
        if self.w(i) != "<":
            return i
        depth, j = 0, i
        while j < self.size and j < i + 400:
            w = self.w(j)
            if w == "<":
                depth += 1
            elif w == ">":
                depth -= 1
                if not depth:
                    return j + 1
            elif w in _OPEN and j in self.match:
                j = self.match[j]
            elif w in (";", "}"):
                break
            j += 1
        return i

    def body_after(self, i: int, stops: tuple[str, ...] = (";",)) -> int | None:
        """The curly bracket that opens the body of a head that goes on at ``i``."""
        while i < self.size:
            w = self.w(i)
            if w == "{":
                return i if i in self.match else None
            if w in stops or w in _CLOSE:
                return None
            i = self.match.get(i, i) + 1 if w in _OPEN else i + 1
        return None

    def add(self, name: str, names: tuple[str, ...], first: int, end: int, paren: int | None, body: int | None, decorated: int | None = None) -> None:
        """``first``: token that begins the definition, ``decorated``: token that begins its decorators."""
        start = self.start[first]
        doc = self.lines.above(self.lines.line(start))
        top = first
        if decorated is not None and decorated < first:
            top = decorated
            doc = doc or self.lines.above(self.line(decorated))
        close = self.match.get(paren, paren) if paren is not None else first
        each = self._each(paren, close) if paren is not None else []
        e = self.end(min(end, self.size - 1))
        stop = body if body is not None else min(end, self.size - 1) + 1
        sig = " ".join(self.text[start : self.start[body] if body is not None else e].split())
        s = self.start[top]
        types = f"{','.join(self._types(each))}:{self._result(first, paren, close, stop)}"
        self.out.append(Function("::".join((*names, name)), name, sig, len(each), types, self.line(top), self.lines.line(max(s, e - 1)), s, e, doc, body is not None))

    def _each(self, paren: int, close: int) -> list[tuple[int, int]]:
        """Where each parameter between the brackets begins and ends."""
        out, j, at = [], paren + 1, paren + 1
        while j < close:
            w = self.w(j)
            if w in _OPEN:
                j = self.match.get(j, j)
            elif w == "<":
                j = max(j, self.angle(j) - 1)
            elif w == ",":
                out.append((at, j))
                at = j + 1
            j += 1
        return [*out, (at, close)] if at < close else out

    def _spell(self, a: int, b: int) -> str:
        """A type without blanks, without the path before its name, without lifetimes."""
        out: list[str] = []
        for j in range(max(a, 0), b):
            w = self.word[j]
            if self.kind[j] == "u" or w in _TYPE_NOISE:
                continue
            if w in (".", "::") and out and self.k(j + 1) == "w":
                out.pop()
            else:
                out.append(w)
        return "".join(out)

    def _types(self, each: list[tuple[int, int]]) -> list[str]:
        """The parameters' types; empty where none is given."""
        if self.lang == "java":
            out = []
            for a, b in each:
                while a < b and self.w(a) == "@":
                    a += 2
                    while self.w(a) == ".":
                        a += 2
                    a = self.match.get(a, a) + 1 if self.w(a) == "(" else a
                out.append(self._spell(a, b - 1))
            return out
        if self.lang == "go":
            own = [(a, b, self.k(a) == "w" and b > a + 1 and self.w(a + 1) != ".") for a, b in each]
            if not any(n for _, _, n in own):
                return [self._spell(a, b) for a, b, _ in own]
            out, last = [], ""
            for a, b, named in reversed(own):
                last = self._spell(a + 1, b) if named else last
                out.append(last)
            return out[::-1]
        out = []
        for a, b in each:
            colon = equals = None
            j = a
            while j < b:
                w = self.w(j)
                if w in _OPEN:
                    j = self.match.get(j, j)
                elif w == ":" and colon is None:
                    colon = j
                elif w == "=" and equals is None:
                    equals = j
                j += 1
            out.append(self._spell(colon + 1, equals or b) if colon is not None else "")
        return out

    def _result(self, first: int, paren: int | None, close: int, stop: int) -> str:
        """The result's type; empty where none is given."""
        if paren is None:
            return ""
        if self.lang == "java":
            a, b = first, paren - 1
            while self.w(a) in _JAVA_MODIFIERS:
                a += 1
            return self._spell(self.angle(a), b)
        a = close + 1
        if self.lang == "go":
            return self._spell(a, stop)
        if self.w(a) not in (":", "->"):
            return ""
        b = a + 1
        while b < stop and self.w(b) not in ("where", ";", "=>"):
            b = self.match.get(b, b) + 1 if self.w(b) in _OPEN else b + 1
        return self._spell(a + 1, min(b, stop))

    def declare(self, name: str, names: tuple[str, ...], first: int, paren: int, decorated: int | None = None) -> None:
        """A declaration without a body: to the semicolon, or the end of the line on which its result stands."""
        end = self.match[paren]
        line = self.line(end)
        while end + 1 < self.size and self.w(end + 1) not in ((";",) if self.lang in ("java", "rust") else (";", ",")) and self.w(end + 1) not in _CLOSE and (self.line(end + 1) == line or self.lang in ("java", "rust")):
            end = self.match.get(end + 1, end + 1)
            line = self.lines.line(self.end(end) - 1)
        self.add(name, names, first, end, paren, None, decorated)

    def add_type(self, i: int, name: str, names: tuple[str, ...], kind: str, body: int, bases: list[tuple[str, str]]) -> None:
        self.types.append(("::".join((*names, name)), name, kind, self.line(i), self.line(self.match.get(body, body)), bases))

    def bases(self, i: int, body: int, words: dict[str, str]) -> list[tuple[str, str]]:
        """Names behind ``extends``, ``implements`` and the like in a head: (kind of reference, name)."""
        out, kind, depth = [], "", 0
        for j in range(i, body):
            w = self.w(j)
            depth += (w == "<") - (w == ">")
            if depth:
                continue
            if w in words:
                kind = words[w]
            elif kind and self.k(j) == "w" and self.w(j + 1) not in (".", "::"):
                out.append((kind, w))
        return out

    # -- JavaScript, TypeScript ------------------------------------------------------------------------------------
    def _decorators(self, i: int) -> int:
        """The token that begins the decorators or annotations in front of ``i``."""
        while True:
            j = i - 1
            if self.w(j) == ")" and j in self.match:
                j = self.match[j] - 1
            if self.k(j) != "w":
                return i
            while self.w(j - 1) == "." and self.k(j - 2) == "w":
                j -= 2
            if self.w(j - 1) != "@":
                return i
            i = j - 1

    def _ecma(self, i: int, k: str, w: str, names: tuple[str, ...], kind: str) -> None:
        if k == "w":
            if w == "function" and self.w(i - 1) != ".":
                j = i + 1 + (self.w(i + 1) == "*")
                own = self.w(j) if self.k(j) == "w" else None
                p = self.angle(j + 1 if own else j)
                if self.w(p) != "(" or p not in self.match:
                    return
                first = i - (self.w(i - 1) == "async")
                bound = self._bound(first)
                body = self.body_after(self.match[p] + 1)
                name, at = (bound if bound else (own, self._exported(first)))
                if self.lang == "typescript" and own and not bound and self._no_body(p):
                    self.declare(own, names, at, p)
                    return
                if name and body is not None:
                    self.add(name, names, at, self.match[body], p, body)
                if body is not None:
                    self.scope[body] = ((*names, name) if name else names, "code")
            elif w == "class" and self.w(i - 1) != "." and self.w(i + 1) not in (":", ",", "=", ")", ";", "("):
                name = self.w(i + 1) if self.k(i + 1) == "w" and self.w(i + 1) not in ("extends", "implements") else None
                if name is None and (b := self._bound(i)):
                    name = b[0]
                body = self.body_after(i + 1)
                if body is not None:
                    self.scope[body] = ((*names, name) if name else names, "class")
                    if name:
                        self.add_type(i, name, names, "class", body, self.bases(i, body, {"extends": "extends", "implements": "implements"}))
            elif w in ("interface", "namespace") and self.lang == "typescript" and self.k(i + 1) == "w" and kind in ("top", "code"):
                body = self.body_after(i + 1)
                if body is not None and w == "interface":
                    self.scope[body] = ((*names, self.w(i + 1)), "interface")
                    self.add_type(i, self.w(i + 1), names, "interface", body, self.bases(i, body, {"extends": "extends"}))
            elif kind in ("class", "object", "interface") or (kind in ("code", "top") and self._in_object(i)):
                self._member(i, names, kind)
        elif w == "=>":
            self._arrow(i, names)

    def _in_object(self, i: int) -> bool:
        return self.w(i + 1) == "(" and self.w(i - 1) in ("{", ",", "async", "get", "set", "*") and (self.w(i - 1) != "{" or self.w(i - 2) in ("=", "(", ":", ",", "return", "=>", "[", "?"))

    def _member(self, i: int, names: tuple[str, ...], kind: str) -> None:
        w = self.w(i)
        p = self.angle(i + 1 + (self.w(i + 1) == "?"))
        if w in _JS_NOT_METHOD or self.w(p) != "(" or p not in self.match or self.w(i - 1) in (".", "new", "?."):
            return
        if kind == "class" and self.w(i - 1) in ("=", ":", ",", "(", "return"):
            return
        body = self.body_after(self.match[p] + 1, (";", ",", "=>", "=") if self.lang == "javascript" else (";", ",", "="))
        nxt = self.w(self.match[p] + 1)
        if self.lang == "typescript" and kind in ("class", "interface") and self._no_body(p):
            first = i
            while self.w(first - 1) in _JS_MODIFIERS:
                first -= 1
            if kind == "interface" or nxt in (":", ";"):
                self.declare(w, names, first, p, self._decorators(first))
            return
        if body is not None and not (body == self.match[p] + 1 or nxt == ":"):
            return
        if body is None:
            return
        if nxt == ":":
            # A type may hold a curly bracket itself: the body is the last one before the next member.
            while self.w(self.match[body] + 1) in ("|", "&", "{", "["):
                more = self.body_after(self.match[body] + 1)
                if more is None:
                    break
                body = more
        first = i
        while self.w(first - 1) in _JS_MODIFIERS or self.w(first - 1) == "*":
            first -= 1
        name = w.lstrip("#")
        self.add(name, names, first, self.match[body], p, body, self._decorators(first))
        self.scope[body] = ((*names, name), "code")

    def _no_body(self, p: int) -> bool:
        """Whether a TypeScript head whose parameters open at ``p`` ends without a body: with a semicolon, with its line,
        or with the surrounding bracket."""
        j = self.match[p] + 1
        if self.w(j) == "{":
            return False
        if self.w(j) == ":":
            j += 1
            while self.w(j) in ("{", "[", "(", "|", "&") or self.k(j) in "wsn" and self.k(j) or self.w(j) in ("<", ".", "=>", ">", "?"):
                if self.w(j) == "{" and self.w(j - 1) not in (":", "|", "&", "=>"):
                    return False
                nxt = self.angle(j) if self.w(j) == "<" else self.match.get(j, j) + 1 if self.w(j) in _OPEN else j + 1
                if self.line(min(nxt, self.size - 1)) != self.line(nxt - 1) and self.w(nxt) not in ("|", "&", "{", "=>", "."):
                    return True
                j = nxt if nxt > j else j + 1
        return self.w(j) in (";", "", "}") or self.line(min(j, self.size - 1)) != self.line(j - 1) and self.w(j) != "{"

    def _exported(self, i: int) -> int:
        while self.w(i - 1) in ("export", "default", "declare", "async"):
            i -= 1
        return i

    def _bound(self, i: int) -> tuple[str, int] | None:
        """Name that the value starting at ``i`` is bound to, and the first token of the binding."""
        if self.w(i - 1) == ":" and self.k(i - 2) == "w" and self.w(i - 3) in ("{", ","):
            return self.w(i - 2), i - 2
        if self.w(i - 1) != "=":
            return None
        j = i - 2
        if self.k(j) != "w" or self.w(j - 1) in (":", "|", "&", "<", "=>", ">") or self.w(j) == ">":
            # a type annotation: back to the colon that follows the name
            while j > 0 and not (self.w(j) == ":" and self.k(j - 1) == "w"):
                if self.w(j) in _CLOSE and j in self.match:
                    j = self.match[j]
                elif self.w(j) in (";", "{", "=", "}"):
                    return None
                j -= 1
            j -= 1
        if self.k(j) != "w":
            return None
        name, at = self.w(j), j
        while self.w(at - 1) == "." and self.k(at - 2) == "w":
            at -= 2
        if self.w(at - 1) in ("const", "let", "var"):
            at -= 1
        while self.w(at - 1) in _JS_MODIFIERS:
            at -= 1
        return name.lstrip("#"), at

    def _arrow(self, i: int, names: tuple[str, ...]) -> None:
        j, p = i - 1, None
        if self.w(j) != ")" and not (self.k(j) == "w" and self.w(j - 1) not in (":", "|", "&", ".", "is")):
            # a return type: back to the parameters
            while j > 0 and not (self.w(j) == ":" and self.w(j - 1) == ")"):
                if self.w(j) in (";", "{", "=", "=>", ","):
                    return
                j = self.match[j] - 1 if self.w(j) in _CLOSE and j in self.match else j - 1
            j -= 1
        elif self.w(j) != ")" and self.w(j - 1) == ":" and self.w(j - 2) == ")":
            j -= 2
        if self.w(j) == ")":
            if j not in self.match:
                return
            p = self.match[j]
            j = p
        elif self.k(j) == "w" and self.w(j - 1) == ":" and self.w(j - 2) == ")":
            j = p = self.match.get(j - 2)
            if p is None:
                return
        first = j
        if self.w(first - 1) == ">":
            depth, a = 0, first - 1
            while a > 0:
                depth += (self.w(a) == ">") - (self.w(a) == "<")
                if not depth:
                    break
                a -= 1
            first = a
        if self.w(first - 1) == "async":
            first -= 1
        bound = self._bound(first)
        body = i + 1 if self.w(i + 1) == "{" and i + 1 in self.match else None
        if bound and i + 1 < self.size:
            end = self.match[body] if body is not None else self._expression_end(i + 1)
            self.add(bound[0], names, bound[1], end, p, i + 1)
        if body is not None:
            self.scope[body] = ((*names, bound[0]) if bound else names, "code")

    def _expression_end(self, i: int) -> int:
        while i < self.size - 1 and self.w(i) not in (";", ",") and self.w(i) not in _CLOSE:
            i = self.match.get(i, i) + 1 if self.w(i) in _OPEN else i + 1
        return max(0, i - 1)

    # -- Go --------------------------------------------------------------------------------------------------------
    def _go(self, i: int, k: str, w: str, names: tuple[str, ...], kind: str) -> None:
        if w == "type" and k == "w" and self.k(i + 1) == "w" and self.w(i + 2) in ("struct", "interface") and i + 3 in self.match:
            self.add_type(i, self.w(i + 1), names, self.w(i + 2), i + 3, [])
            if self.w(i + 2) == "interface":
                j, end = i + 4, self.match[i + 3]
                while j < end:
                    if self.k(j) == "w" and self.w(j + 1) == "(" and j + 1 in self.match and self.line(j - 1) != self.line(j):
                        self.declare(self.w(j), (*names, self.w(i + 1)), j, j + 1)
                    j = self.match.get(j, j) + 1 if self.w(j) in _OPEN else j + 1
        if w != "func" or k != "w":
            return
        j, receiver = i + 1, None
        if self.w(j) == "(" and kind == "top" and j in self.match and self.k(self.match[j] + 1) == "w" and self.w(self.match[j] + 2) in ("(", "["):
            inside = [self.w(x) for x in range(j + 1, self.match[j]) if self.k(x) == "w"]
            depth = [x for x in range(j + 1, self.match[j]) if self.w(x) == "["]
            if depth:
                inside = [self.w(x) for x in range(j + 1, depth[0]) if self.k(x) == "w"]
            receiver = inside[-1] if inside else None
            j = self.match[j] + 1
        if self.k(j) == "w" and kind == "top":
            p = self.match.get(j + 1, j) + 1 if self.w(j + 1) == "[" else j + 1
            if self.w(p) != "(" or p not in self.match:
                return
            own = (*names, receiver) if receiver else names
            body = self._go_body(self.match[p] + 1)
            if body is not None:
                self.scope[body] = ((*own, self.w(j)), "code")
                self.add(self.w(j), own, i, self.match[body], p, body)
            return
        if self.w(j) == "(" and j in self.match:
            body = self._go_body(self.match[j] + 1)
            if body is None:
                return
            name, first = None, i
            if self.w(i - 1) in (":=", "=") and self.k(i - 2) == "w" and self.w(i - 3) != ",":
                name, first = self.w(i - 2), i - 2
                while self.w(first - 1) == "." and self.k(first - 2) == "w":
                    first -= 2
                if self.w(first - 1) == "var":
                    first -= 1
            if name:
                self.add(name, names, first, self.match[body], j, body)
            self.scope[body] = ((*names, name) if name else names, "code")

    def _go_body(self, i: int) -> int | None:
        """The body behind a result type, whose own curly brackets follow ``struct`` or ``interface``."""
        line = self.line(i - 1)
        while i < self.size:
            w = self.w(i)
            if w == "{":
                if i not in self.match:
                    return None
                if self.w(i - 1) not in ("struct", "interface"):
                    return i
                i = self.match[i]
            elif w in ("(", "[") and i in self.match:
                i = self.match[i]
            elif w in _CLOSE or w in (";", ",", "=", ":=") or self.line(i) != line:
                return None
            line = self.lines.line(self.start[i])
            i += 1
        return None

    # -- Java ------------------------------------------------------------------------------------------------------
    def _java(self, i: int, k: str, w: str, names: tuple[str, ...], kind: str) -> None:
        if k != "w":
            if w == "->":
                self._java_lambda(i, names)
            return
        if w in ("class", "interface", "enum", "record") and self.k(i + 1) == "w" and self.w(i - 1) != ".":
            if w == "record" and self.w(self.angle(i + 2)) != "(":
                return
            body = self.body_after(i + 2)
            if body is not None:
                self.scope[body] = ((*names, self.w(i + 1)), "class")
                self.add_type(i, self.w(i + 1), names, w if w in ("interface", "enum") else "class", body, self.bases(i + 2, body, {"extends": "extends", "implements": "implements"}))
        elif w == "new":
            j = i + 1
            while self.k(j) == "w" or self.w(j) == ".":
                j += 1
            j = self.angle(j)
            if self.w(j) == "(" and j in self.match and self.w(self.match[j] + 1) == "{":
                self.scope[self.match[j] + 1] = (names, "class")
        elif kind == "class" and self.w(i + 1) == "(" and i + 1 in self.match and self.w(i - 1) not in ("@", ".", "new", "="):
            p = i + 1
            first = i
            while first > 0:
                x = self.w(first - 1)
                if self.k(first - 1) == "w" and self.w(first - 2) != "@" and x not in ("class", "return"):
                    first -= 1
                elif x in (">", "]", "?", "<", "&", ".") or (x == "," and self._inside_angle(first - 1)):
                    first -= 1
                elif x == "[":
                    first -= 1
                else:
                    break
            if first == i and self.w(i) != (names[-1] if names else ""):
                return
            after = self.match[p] + 1
            body = self.body_after(after, (";", "="))
            if body is None:
                if self.w(after) in (";", "throws") and first != i:
                    self.declare(w, names, first, p, self._decorators(first))
                return
            if self.w(after) not in ("{", "throws", "[", "@"):
                return
            dec = self._decorators(first)
            # annotations may stand between modifiers
            self.add(w, names, first, self.match[body], p, body, dec)
            self.scope[body] = ((*names, w), "code")

    def _inside_angle(self, i: int) -> bool:
        j, depth = i, 0
        while j > max(0, i - 60):
            x = self.w(j)
            if x == "<":
                if not depth:
                    return True
                depth -= 1
            elif x == ">":
                depth += 1
            elif x in (";", "{", "}", "(", ")"):
                return False
            j -= 1
        return False

    def _java_lambda(self, i: int, names: tuple[str, ...]) -> None:
        j = self.match[i - 1] if self.w(i - 1) == ")" and i - 1 in self.match else i - 1
        body = i + 1 if self.w(i + 1) == "{" and i + 1 in self.match else None
        if self.w(j - 1) != "=" or self.k(j - 2) != "w" or i + 1 >= self.size:
            return
        name, first = self.w(j - 2), j - 2
        while first > 0 and (self.k(first - 1) == "w" or self.w(first - 1) in (">", "<", ",", "?", ".", "]", "[")) and self.w(first - 1) != "return":
            first -= 1
        end = self.match[body] if body is not None else self._expression_end(i + 1)
        self.add(name, names, first, end, j if self.w(j) == "(" else None, i + 1)
        if body is not None:
            self.scope[body] = ((*names, name), "code")

    # -- Rust ------------------------------------------------------------------------------------------------------
    def _attributes(self, i: int) -> int:
        while self.w(i - 1) == "]" and i - 1 in self.match and self.w(self.match[i - 1] - 1) == "#":
            i = self.match[i - 1] - 1
        return i

    def _rust(self, i: int, k: str, w: str, names: tuple[str, ...], kind: str) -> None:
        if k != "w":
            return
        if w == "fn" and self.k(i + 1) == "w":
            p = self.angle(i + 2)
            if self.w(p) != "(" or p not in self.match:
                return
            first = i
            while True:
                x = first - 1
                if self.k(x) == "s":
                    x -= 1
                if self.w(x) == ")" and x in self.match and self.w(self.match[x] - 1) == "pub":
                    first = self.match[x] - 1
                elif self.w(x) in _RUST_HEAD:
                    first = x
                else:
                    break
            body = self.body_after(self.match[p] + 1)
            name = self.w(i + 1).removeprefix("r#")
            if body is not None:
                self.scope[body] = ((*names, name), "code")
                self.add(name, names, first, self.match[body], p, body, self._attributes(first))
            elif kind == "class":
                self.declare(name, names, first, p, self._attributes(first))
        elif w == "impl" and kind in ("top", "code", "mod", "block"):
            j = self.angle(i + 1)
            body = self.body_after(j)
            if body is None:
                return
            target = None
            x = j
            while x < body:
                word = self.w(x)
                if word == "for" and self.w(x + 1) != "<":
                    target = None
                elif word == "where":
                    break
                elif word == "<":
                    x = max(x, self.angle(x) - 1)
                elif self.k(x) == "w" and word not in ("dyn", "mut", "const", "unsafe", "crate", "self", "super"):
                    target = word
                x += 1
            self.scope[body] = ((*names, target) if target else names, "class")
            if target and (trait := next((self.w(x) for x in range(j, body) if self.k(x) == "w" and self.w(x + 1) in ("for", "<") and any(self.w(y) == "for" for y in range(x, body))), None)):
                self.types.append((target, target, "", self.line(i), self.line(i), [("implements", trait)]))
        elif w in ("trait", "mod") and self.k(i + 1) == "w":
            body = self.body_after(i + 2)
            if body is not None:
                self.scope[body] = ((*names, self.w(i + 1)) if w == "trait" else names, "class" if w == "trait" else "mod")
                if w == "trait":
                    self.add_type(i, self.w(i + 1), names, "trait", body, [])
        elif w in ("struct", "enum") and self.k(i + 1) == "w" and kind != "class":
            body = self.body_after(self.angle(i + 2))
            if body is not None:
                self.add_type(i, self.w(i + 1), names, w, body, [])
        elif w == "let":
            j = i + 1 + (self.w(i + 1) == "mut")
            if self.k(j) != "w":
                return
            e = j + 1
            while e < self.size and self.w(e) not in ("=", ";", "{", "}"):
                e = self.match.get(e, e) + 1 if self.w(e) in ("(", "[") else e + 1
            v = e + 1 + (self.w(e + 1) == "async")
            v += self.w(v) == "move"
            if self.w(e) == "=" and self.w(v) in ("|", "||"):
                end = v + 1
                while end < self.size - 1 and self.w(end) != ";":
                    end = self.match.get(end, end) + 1 if self.w(end) in _OPEN else end + 1
                b = next((x for x in range(v, end) if self.w(x) == "{" and x in self.match), None)
                if b is not None:
                    self.scope[b] = ((*names, self.w(j)), "code")
                self.add(self.w(j), names, i, end, None, v)
