"""Tokens of the six source languages, shared by the operators that read code.

``lex(lang, text)`` gives ``(tokens, error)``: a list of ``(kind, start, end)`` over the text with normalised line
ends (``normalise``), and the reason why the rest could not be read, or None. Kinds: ``w`` word, ``n`` number, ``s``
string or character, ``r`` regular expression, ``p`` punctuation, ``c`` comment, ``l`` line end, ``t`` the text parts
of a template (its embedded expressions are ordinary tokens between ``p`` tokens ``${`` and ``}``), ``u`` lifetime.
Python's indentation is left to the parser; Go's implied semicolons are left to the parser too.

``tokens_of(lang, text)`` gives the same tokens as columns. It finds them all by one search, without a step in Python for
each; only texts whose tokens depend on what stands before them (regular expressions and templates of JavaScript, nested
comments of Rust) go through ``lex``.
"""

from __future__ import annotations

import ast
import re
import warnings
from functools import lru_cache
from itertools import accumulate, chain

LANGUAGE_OF = {".py": "python", ".js": "javascript", ".ts": "typescript", ".go": "go", ".java": "java", ".rs": "rust"}

_WORD = r"[^\W\d][\w\u0300-\u036f\u200c\u200d]*"
_NUM_C = r"(?:0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)(?:\.\d[\d_]*|\.(?![\w.]))?(?:[eE][+-]?\d[\d_]*)?|\.\d[\d_]*(?:[eE][+-]?\d[\d_]*)?)"
_DQ = r'"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*"'
_SQ = r"'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*'"
_LINE, _BLOCK = r"//[^\n]*", r"/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"
#: A block comment without another one inside.
_BLOCK_ONE = r"/\*[^*/]*(?:(?:\*(?!/)|/(?!\*))[^*/]*)*\*/"
_PY_SPACE = r" \t\f"


#: Raw strings of Rust with up to four signs, for the search without groups; more of them are left to ``lex``.
_RAW = r"(?:br|cr|r)(?:" + "|".join(rf'{"#" * n}"[\s\S]*?"{"#" * n}(?!#)' for n in range(5)) + ")"
_RAW_ANY = r"(?:br|cr|r)(?P<h>#*)\"[\s\S]*?\"(?P=h)(?!#)"


def _master(space: str, rest: str, alone: str, *parts: tuple[str, str]) -> tuple[re.Pattern, re.Pattern]:
    """The pattern of one token with its kind, and the one that finds all blanks and tokens of a text. That one tries the
    frequent ones first: plain words (``rest``: what follows their first letter) that are no prefix of a string, and the
    signs ``alone`` that begin no longer one."""
    named = "|".join(f"(?P<{k}>{p})" for k, p in (*parts, ("z", f"[^{space}]")))
    block = _BLOCK_ONE if any(k == "q" and p == r"/\*" for k, p in parts) else None
    plain = [p.replace(_RAW_ANY, _RAW) if k == "s" else r"\n[ \t\f]*" if k == "l" and space == _PY_SPACE else p for k, p in parts]
    quick = [plain[0], rf"[A-Za-z_]{rest}*+(?![\\\"'#$])", alone]
    alts = "|".join(quick + ([block] if block else []) + plain[1:] + [f"[^{space}]"])
    return re.compile(f"[{space}]*(?:{named})"), re.compile(f"([{space}]*)({alts})")


_JS_SPACE = r" \t\f\v\xa0\ufeff\u1680\u2000-\u200a\u202f\u205f\u3000"
_JS = _master(
    _JS_SPACE,
    r"[\w$\u0300-\u036f\u200c\u200d]",
    r"[()\[\]{};,:]",
    ("l", r"[\n\u2028\u2029]"),
    ("w", r"#?(?:[^\W\d]|\$|\\u[\da-fA-F]{4})[\w$\u0300-\u036f\u200c\u200d]*(?:\\u[\da-fA-F]{4}[\w$\u0300-\u036f\u200c\u200d]*)*"),
    ("c", f"{_LINE}|{_BLOCK}"),
    ("n", f"{_NUM_C}n?"),
    ("s", f"{_DQ}|{_SQ}"),
    ("q", r"/=?|[`{}]"),
    ("p", r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|%=|&=|\|=|\^=|\*\*|<<|[()\[\];,<>+\-*%&|^!~?:=.@]"),
)
_JS_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[\w$]*")
_MASTERS = {
    "javascript": _JS,
    "typescript": _JS,
    "java": _master(
        r" \t\f\x1a",
        r"[\w$\u0300-\u036f\u200b-\u200f\u2060\ufeff]",
        r"[()\[\]{};,@?]",
        ("l", r"\n"),
        ("w", r"(?:[^\W\d]|\$)[\w$\u0300-\u036f\u200b-\u200f\u2060\ufeff]*"),
        ("c", f"{_LINE}|{_BLOCK}"),
        ("n", f"{_NUM_C}[lLfFdD]?"),
        ("s", r'"""[^"\\]*(?:(?:\\[\s\S]|"(?!""))[^"\\]*)*"""|' + _DQ + "|" + r"'(?:[^'\\\n]|\\(?:u+[\da-fA-F]{4}|[0-7]{1,3}|[^\n]))'"),
        ("p", r"\.\.\.|->|::|<<=|\+\+|--|&&|\|\||==|!=|<=|\+=|-=|\*=|/=|&=|\|=|\^=|%=|<<|[{}()\[\];,<>+\-*/%&|^!~?:=.@]"),
    ),
    "go": _master(
        r" \t",
        r"\w",
        r"[()\[\]{};,]",
        ("l", r"\n"),
        ("w", r"[^\W\d]\w*"),
        ("c", f"{_LINE}|{_BLOCK}"),
        ("n", f"{_NUM_C}i?"),
        ("s", _DQ + r"|`[^`]*`|'(?:[^'\\\n]|\\(?:x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}|[0-7]{3}|[^\n]))'"),
        ("p", r"\.\.\.|<<=|>>=|&\^=|:=|\+\+|--|&&|\|\||<-|==|!=|<=|>=|\+=|-=|\*=|/=|&=|\|=|\^=|%=|<<|>>|&\^|[{}()\[\];,<>+\-*/%&|^!~:=.]"),
    ),
    "rust": _master(
        r" \t\f\v\x85\u200e\u200f\u2028\u2029",
        r"[\w\u0300-\u036f\u200c\u200d]",
        r"[()\[\]{};,#?]",
        ("l", r"\n"),
        ("s", _RAW_ANY + r"|(?:b|c)?\"[^\"\\]*(?:\\[\s\S][^\"\\]*)*\"|b?'(?:[^'\\\n]|\\(?:x[\da-fA-F]{2}|u\{[\da-fA-F_]+\}|[^\n]))'"),
        ("u", rf"'{_WORD}(?!')"),
        ("w", rf"(?:r#)?{_WORD}"),
        ("c", r"//[^\n]*"),
        ("q", r"/\*"),
        ("n", r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.\d[\d_]*|\.(?![\w.]))?(?:[eE][+-]?\d[\d_]*)?)(?:[iu](?:8|16|32|64|128|size)|f(?:32|64))?"),
        ("p", r"\.\.\.|\.\.=|<<=|->|=>|::|\.\.|&&|\|\||==|!=|<=|\+=|-=|\*=|/=|&=|\|=|\^=|%=|<<|[{}()\[\];,<>+\-*/%&|^!~?:=.@#$]"),
    ),
    "python": _master(
        _PY_SPACE,
        r"[\w\u0300-\u036f\xb7]",
        r"[()\[\]{};,]",
        ("l", r"\n"),
        ("c", r"#[^\n]*"),
        ("s", r"(?:[rR][bBfFtT]?|[bBfFtT][rR]?|[uU])?(?:\"\"\"[^\"\\]*(?:(?:\\[\s\S]|\"(?!\"\"))[^\"\\]*)*\"\"\"|'''[^'\\]*(?:(?:\\[\s\S]|'(?!''))[^'\\]*)*'''|\"[^\"\\\n]*(?:\\[\s\S][^\"\\\n]*)*\"|'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*')"),
        ("w", r"[^\W\d][\w\u0300-\u036f\xb7]*"),
        ("n", r"(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)"),
        ("x", r"\\\n"),
        ("p", r"\*\*=|//=|>>=|<<=|\.\.\.|:=|->|\*\*|//|>>|<<|<=|>=|==|!=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[{}()\[\];,<>+\-*/%&|^~:=.@]"),
    ),
}
#: After one of these words a slash starts a regular expression.
_BEFORE_REGEX = frozenset("return typeof instanceof in of new delete void throw case do else yield await default".split())
_NEST = re.compile(r"/\*|\*/")


def normalise(text: str) -> str:
    """One line end for all, and no byte-order mark."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return text[1:] if text.startswith("\ufeff") else text


@lru_cache(maxsize=2)
def lex(lang: str, text: str) -> tuple[list[tuple[str, int, int]], str | None]:
    """Tokens of ``text`` and the reason why the rest was not read, if any; the last texts' are kept, not to be changed."""
    find, out, at, end = _MASTERS[lang][0].finditer, [], 0, len(text)
    add = out.append
    js = lang in ("javascript", "typescript")
    if js and text.startswith("#!") or lang == "rust" and re.match(r"#![^\[]", text) and not re.match(r"#!\s*\[", text):
        at = text.find("\n") if "\n" in text else end
        add(("c", 0, at))
    braces: list[int] = []  # depth of braces of each open template
    depth = 0
    while at < end:
        for m in find(text, at):
            kind = m.lastgroup
            start, at = m.span(kind)
            if kind != "q":
                if kind == "z":
                    return out, f"unreadable character at {start}: {text[start : start + 12]!r}"
                add((kind, start, at))
                continue
            # what the pattern alone cannot tell; the search goes on behind it
            c = text[start]
            if not js:
                nest, at = 1, start + 2
                while nest:
                    n = _NEST.search(text, at)
                    if n is None:
                        return out, f"unterminated comment at {start}"
                    nest += 1 if n[0] == "/*" else -1
                    at = n.end()
                add(("c", start, at))
                break
            if c == "/":
                if _regex_may_start(out, text):
                    r = _JS_REGEX.match(text, start)
                    if r is None:
                        return out, f"unterminated regular expression at {start}"
                    at = r.end()
                    add(("r", start, at))
                    break
            elif c == "`" or (c == "}" and braces and depth == braces[-1]):
                if c == "}":
                    add(("p", start, at))
                    braces.pop()
                stop = _template(text, at)
                if stop is None:
                    return out, f"unterminated template at {start}"
                at = stop
                first = start if c == "`" else start + 1
                if text[stop - 1] == "{":
                    add(("t", first, stop - 2))
                    add(("p", stop - 2, stop))
                    braces.append(depth)
                else:
                    add(("t", first, stop))
                    add(("e", stop, stop))
                break
            else:
                depth += 1 if c == "{" else -1
            add(("p", start, at))
        else:
            break
    return (out, None) if not braces else (out, "unterminated template")


#: Words of a language that a worker keeps.
KEPT_WORDS = 40_000


class _Kinds(dict):
    """The kind of a token by its text; long texts are not kept, and all are forgotten when there are too many."""

    def __init__(self, lang: str):
        super().__init__()
        self.one = _MASTERS[lang][0]

    def __missing__(self, w: str) -> str:
        m = self.one.match(w)
        kind = m.lastgroup if m and m.end() == len(w) else "l" if w[0] == "\n" else "c" if w.startswith("/*") else "z"
        if kind == "q" and w in "{}":
            kind = "p"
        if len(w) <= 40:
            if len(self) > KEPT_WORDS:
                self.clear()
            self[w] = kind
        return kind


_kinds = {lang: _Kinds(lang) for lang in _MASTERS}


#: Signs of JavaScript whose meaning depends on what stands before them.
_OPEN_JS = frozenset(("`", "/", "/="))


class Tokens:
    """The tokens of a text as columns: their texts, first places, a string of one kind for each; and why the rest could
    not be read. A new line of Python holds the blanks that follow it."""

    __slots__ = ("lang", "words", "error", "easy", "_pairs", "_kinds", "_at")

    def __init__(self, lang: str, text: str):
        self.lang = lang
        self._pairs = _MASTERS[lang][1].findall(text)
        self.words = [w for _, w in self._pairs]
        self.error = self._kinds = self._at = None
        #: Whether the texts alone tell the kinds.
        self.easy = not (text.startswith("#!") and lang != "python" or lang == "rust" and ("/*" in self.words or 'r#####"' in text) or lang in ("javascript", "typescript") and not _OPEN_JS.isdisjoint(self.words))
        if not self.easy:
            tokens, self.error = lex(lang, text)
            self.words = [text[s:e] for _, s, e in tokens]
            self._kinds = "".join(k for k, _, _ in tokens)
            self._pairs, self._at = None, [s for _, s, _ in tokens]

    @property
    def kinds(self) -> str:
        if self._kinds is None:
            self._kinds = "".join(map(_kinds[self.lang].__getitem__, self.words))
        return self._kinds

    @property
    def starts(self) -> list[int]:
        if self._at is None:
            self._at, self._pairs = list(accumulate(map(len, chain.from_iterable(self._pairs))))[0::2], None
        return self._at

    def end(self, i: int) -> int:
        return self.starts[i] + len(self.words[i])

    def unread(self) -> str | None:
        """Why the text could not be read to its end."""
        if self.error is None and "z" in self.kinds:
            i = self.kinds.index("z")
            self.error = f"unreadable character at {self.starts[i]}: {self.words[i]!r}"
        return self.error


@lru_cache(maxsize=2)
def tokens_of(lang: str, text: str) -> Tokens:
    """The tokens of ``lex`` as columns, to the end of the text even behind what cannot be read; the last texts' are kept."""
    return Tokens(lang, text)


_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")


def _template(text: str, at: int) -> int | None:
    m = _TEMPLATE.match(text, at)
    return m.end() if m else None


def _regex_may_start(out: list, text: str) -> bool:
    for kind, s, e in reversed(out):
        if kind in "lc":
            continue
        if kind == "w":
            return text[s:e] in _BEFORE_REGEX
        if kind == "p":
            return text[e - 1] not in ")]}" and text[s:e] not in ("++", "--")
        return False
    return True


@lru_cache(maxsize=2)
def python_tree(source: str) -> ast.AST | str | None:
    """The syntax tree, the reason why there is none, or None if the parser gave up on the text's depth."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(source)
    except (SyntaxError, ValueError) as x:
        return f"{type(x).__name__}: {getattr(x, 'msg', x)} at line {getattr(x, 'lineno', None)}"
    except (RecursionError, MemoryError):
        return None
