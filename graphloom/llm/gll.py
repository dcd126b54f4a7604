"""A generalised LL recogniser with a graph-structured stack, and shape abstraction over brackets.

A ``Grammar`` is EBNF text: ``Name = alternatives``, quoted literals, lower-case token classes, ``@p:X`` / ``@s:X`` /
``@b:X`` for a round, square or curly group whose inside is an ``X`` (``Any``: anything), ``&nl`` for "a line end or the end comes here".
``recognise`` runs any number of start symbols over one string at once: all alternatives that a token allows are
descriptors on one worklist, calls of the same symbol at the same place share a stack node, so ambiguity and dialects
cost no backtracking and left recursion ends.

Files are not parsed flat. A bracket group is parsed by itself, once for each *shape* (its tokens' classes, inner groups
replaced by the set of symbols that they can stand for), and then is one token of its surroundings. Shapes recur within
and across files, so a worker's memo answers most groups. Lists that are closed under concatenation (statements,
members, elements) are parsed piece by piece in the same way; if the pieces do not do, the whole list is parsed.
A memo keeps what was used last, in two halves, up to a bound in bytes; that changes the speed only.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable

_NL = object()
_BASE = {"p": 0x20000, "s": 0x30000, "b": 0x40000, "i": 0x50000, "e": 0x60000}
#: Bytes that one grammar's memos may hold, about: an entry takes ``_ENTRY`` and four for each character.
_MEMO, _ENTRY = 36_000_000, 130
#: Tokens by which most wrong symbols are told.
_OPENING = 4


class _Loop:
    """Any number of one symbol, as a way back to the same place of the rule: no stack grows with the repetitions."""

    __slots__ = ("body",)

    def __init__(self, body):
        self.body = body


class _Term(dict):
    """Which characters a terminal matches, worked out at first use."""

    def __init__(self, test):
        super().__init__()
        self.test = test

    def __missing__(self, c: str) -> bool:
        self[c] = r = bool(self.test(c))
        return r


class Grammar:
    def __init__(self, text: str, classes: dict[str, Iterable[str]], groups: dict[str, list[str]], starts: dict[str, str], statements: Iterable[str], commas: dict[str, str], joins: Iterable[str] = (), ends: Iterable[str] = (";",), block: str = "b", apart: Iterable[str] = ()):
        """classes: token classes and the literals that also belong to them; groups: what a bracket may hold;
        starts: symbol of each dialect; statements: lists closed under concatenation, ``list:part`` where all but the last
        piece are a part, or ``list:a,b,c`` whose pieces are first a, then b, then c; commas: list and its element, with a comma behind it if one may end the
        list, and ``!`` if it is nothing but such a list;
        joins: literals that continue the piece before them; apart: literals that keep a character of their own."""
        self.classes = classes
        rules = {}
        for m in re.finditer(r"^(\w+) =((?:.|\n(?!\w+ =))*)", text, re.M):
            rules[m[1]] = re.findall(r"'[^']+'|@[psbie]:\w+|&nl|\w+|[()|*+?]", m[2])
        literals = sorted(({t[1:-1] for ts in rules.values() for t in ts if t[0] == "'"} | {x for xs in classes.values() for x in xs}) - set(classes))
        self.code = {x: 0x100 + 2 * i for i, x in enumerate([*classes, *literals, "?"])}
        self.literals = frozenset(literals)
        self.groups, self.bits, self.masks = groups, {(b, nt): 1 << i for b, nts in groups.items() for i, nt in enumerate(nts)}, {}
        self.mask_of: dict[str, int] = {}
        self.names: dict[str, int] = {}
        self.alts: list[list[int]] = []
        self.slots: list = []
        self.terms: dict[str, _Term] = {}
        for n in rules:
            self._nt(n)
        for n, tokens in rules.items():
            for alt in self._alternatives(tokens, [0]):
                self._add(self.names[n], alt)
        missing = [n for n, i in self.names.items() if not self.alts[i]]
        if missing:
            raise ValueError(f"symbols without a rule: {missing}")
        self._merge(apart)
        self._nullable()
        self.predicted: list[dict[str, tuple[int, ...]]] = [{} for _ in self.alts]
        self.starts = {d: self.names[s] for d, s in starts.items()}
        self.statements = {}
        for x in statements:
            whole, _, parts = x.partition(":")
            last = [whole] if parts.count(",") == 0 else parts.split(",")
            self.statements[self.names[whole]] = tuple(self.names[p] for p in (parts or whole).split(",")), tuple(self.names[p] for p in last)
        self.elements = {self.names[x]: (self.names[y.rstrip(",!")], "," in y, "!" in y) for x, y in commas.items()}
        self.inside = {b: [(self.names[nt], 1 << i) for i, nt in enumerate(nts)] for b, nts in groups.items()}
        both = lambda xs: "".join(chr(self.code[x] + k) for x in xs if x in self.code for k in (0, 1))
        end, blocks = both(ends), f"{chr(_BASE[block])}-{chr(_BASE[block] + 0xFFFF)}"
        one = f"[^{end}{blocks}]*(?:[{end}]|[{blocks}]+|$)"
        self.piece = re.compile(f"{one}(?:[{both(joins)}{end}]{one})*", re.S)
        self.comma = re.compile(f"[{''.join(chr(self.code[','] + k) for k in (0, 1))}]") if "," in self.code else None
        #: Characters of words and punctuation, without and with a line end before them.
        self.chars = tuple({x: chr(self.code[x] + k) for x in (*self.literals, *classes, "?")} for k in (0, 1))
        #: Characters as they stand behind a line end; nothing can stand between a line end and a closing bracket.
        self.marked = {**dict(zip(self.chars[0].values(), self.chars[1].values())), **dict(zip("([{\x01)]}", "\x02\x03\x04\x05)]}"))}
        # by symbol, and by bracket and symbols asked for
        self.memo: dict[int, dict[str, int]] = defaultdict(dict)  # -1: derived; else how far any way came
        self.shapes: dict[tuple[str, int], dict[str, int]] = defaultdict(dict)
        self.memo_before, self.shapes_before = defaultdict(dict), defaultdict(dict)
        self.held = 0
        self.openings: dict[tuple[int, str], int] = {}
        self.asked: dict[tuple[str, str], int] = {}
        self._preceding()

    # -- building --------------------------------------------------------------------------------------------------
    def _nt(self, name: str) -> int:
        if name not in self.names:
            self.names[name] = len(self.alts)
            self.alts.append([])
        return self.names[name]

    def _add(self, nt: int, alt: list) -> None:
        self.alts[nt].append(len(self.slots))
        self.slots += [*alt, None]

    def _alternatives(self, tokens: list[str], at: list[int]) -> list[list]:
        alts, now = [], []
        while at[0] < len(tokens) and tokens[at[0]] != ")":
            t = tokens[at[0]]
            at[0] += 1
            if t == "|":
                alts.append(now)
                now = []
                continue
            if t == "(":
                x = self._nt(f"({len(self.alts)})")
                for a in self._alternatives(tokens, at):
                    self._add(x, a)
                at[0] += 1
            else:
                x = self._symbol(t)
            if at[0] < len(tokens) and tokens[at[0]] in "*+?":
                op = tokens[at[0]]
                at[0] += 1
                if op == "?":
                    y = self._nt(f"{t}{op}{len(self.alts)}")
                    self._add(y, [x])
                    self._add(y, [])
                    x = y
                elif op == "*":
                    x = _Loop(x)
                else:
                    now.append(x)
                    x = _Loop(x)
            now.append(x)
        return [*alts, now]

    def _symbol(self, t: str):
        if t == "&nl":
            return _NL
        if t[0] not in "'@" and t not in self.classes:
            return self._nt(t)
        if t not in self.terms:
            if t[0] == "@":
                bit, base = (-1 if t[3:] == "Any" else self.bits[t[1], t[3:]]), _BASE[t[1]]
                self.terms[t] = _Term(lambda c: base <= ord(c) < base + 0x10000 and (bit < 0 or self.mask_of[chr(ord(c) & ~1)] & bit))
            else:
                own = {t[1:-1]} if t[0] == "'" else {t, *self.classes[t]}
                codes = {self.code[x] for x in own}
                self.terms[t] = _Term(lambda c: ord(c) & ~1 in codes)
        return self.terms[t]

    def _merge(self, apart: Iterable[str]) -> None:
        """Literals that stand in the same places of the same rules get one character: no string tells them apart, so
        shapes that differ by them alone are one."""
        term = {t[1:-1]: x for t, x in self.terms.items() if t[0] == "'"}
        word = {id(x): w for w, x in term.items()}
        places: dict[str, set] = {w: {("class", c) for c, own in self.classes.items() if w in own} for w in self.literals}
        for nt, alts in enumerate(self.alts):
            for a in alts:
                end = a
                while self.slots[end] is not None:
                    end += 1
                alt = [("loop", id(x.body)) if isinstance(x, _Loop) else id(x) for x in self.slots[a:end]]
                for i, x in enumerate(self.slots[a:end]):
                    own = x.body if isinstance(x, _Loop) else x
                    if id(own) in word:
                        places[word[id(own)]].add((nt, tuple(alt[:i]), isinstance(x, _Loop), tuple(alt[i + 1 :])))
        first: dict[frozenset, str] = {}
        for w in sorted(self.literals - set(apart)):
            rep = first.setdefault(frozenset(places[w]), w)
            self.code[w] = self.code[rep]

    def _nullable(self) -> None:
        self.null = [False] * len(self.alts)
        changed = True
        while changed:
            changed = False
            for nt, alts in enumerate(self.alts):
                if not self.null[nt] and any(self._empty(a) for a in alts):
                    self.null[nt] = changed = True

    def _preceding(self) -> None:
        """The terminals that can stand before each group's terminal, None for the beginning of a group or file."""
        last: list[set] = [set() for _ in self.alts]
        before: list[set] = [set() for _ in self.alts]
        for nt in {*self.starts.values(), *(nt for nts in self.inside.values() for nt, _ in nts)}:
            before[nt].add(None)
        place: dict[int, set] = {}
        rules = []
        for nt, alts in enumerate(self.alts):
            for a in alts:
                end = a
                while self.slots[end] is not None:
                    end += 1
                rules.append((nt, [x for x in self.slots[a:end] if x is not _NL]))
        size = -1
        while size != (size := sum(map(len, last)) + sum(map(len, before)) + sum(map(len, place.values()))):
            for nt, rule in rules:
                for x in reversed(rule):
                    own = x.body if isinstance(x, _Loop) else x
                    last[nt] |= last[own] if isinstance(own, int) else {id(own)}
                    if not isinstance(x, _Loop) and not (isinstance(x, int) and self.null[x]):
                        break
                came = set(before[nt])
                for x in rule:
                    own = x.body if isinstance(x, _Loop) else x
                    tail = last[own] if isinstance(own, int) else {id(own)}
                    here = came | tail if isinstance(x, _Loop) else came
                    if isinstance(own, int):
                        before[own] |= here
                    else:
                        place.setdefault(id(own), set()).update(here)
                    came = came | tail if isinstance(x, _Loop) or isinstance(x, int) and self.null[x] else set(tail)
        terms = {id(t): t for t in self.terms.values()}
        self.before = {b: [(1 << i, [None if t is None else terms[t] for t in place.get(id(self.terms.get(f"@{b}:{nt}")), ())]) for i, nt in enumerate(nts)] for b, nts in self.groups.items()}

    def asks(self, bracket: str, c: str) -> int:
        """The symbols, as bits, that a group can stand for behind the character ``c`` (or at the beginning)."""
        if (mask := self.asked.get((bracket, c))) is None:
            mask = self.asked[bracket, c] = sum(bit for bit, terms in self.before[bracket] if any(t is None if not c else t is not None and t[c] for t in terms))
        return mask

    def _empty(self, slot: int) -> bool:
        while (x := self.slots[slot]) is not None:
            if isinstance(x, _Term) or (isinstance(x, int) and not self.null[x]):
                return False
            slot += 1
        return True

    def _viable(self, slot: int, c: str, seen: set[int]) -> bool:
        while (x := self.slots[slot]) is not None:
            if x is _NL:
                if not ord(c) & 1:
                    return False
            elif isinstance(x, _Term):
                return x[c]
            elif isinstance(x, _Loop):
                b = x.body
                if b[c] if isinstance(b, _Term) else b not in seen and any(self._viable(a, c, seen | {b}) for a in self.alts[b]):
                    return True
            else:
                if x not in seen and any(self._viable(a, c, seen | {x}) for a in self.alts[x]):
                    return True
                if not self.null[x]:
                    return False
            slot += 1
        return True

    def _predict(self, nt: int, c: str) -> tuple[int, ...]:
        table = self.predicted[nt]
        if (r := table.get(c)) is None:
            r = table[c] = tuple(a for a in self.alts[nt] if self._viable(a, c, {nt}))
        return r

    # -- recognising -----------------------------------------------------------------------------------------------
    def recognise(self, starts: Iterable[int], s: str) -> set[int]:
        """The start symbols that derive all of ``s`` but its last character, which says whether the end counts as a
        line end ("\\x01") or not ("\\x02"). ``far`` is the furthest place at which a way ended."""
        n, slots, predict = len(s) - 1, self.slots, self._predict
        nodes: dict[int, tuple[list, set]] = {}
        work: list[tuple[int, tuple, int]] = []
        roots = {}
        for nt in starts:
            roots[nt] = nodes[nt * (n + 1)] = ([], set())
            work += [(a, roots[nt], 0) for a in predict(nt, s[0])]
        done = set()
        far = 0
        while work:
            slot, node, i = work.pop()
            while True:
                x = slots[slot]
                if x is None:
                    if i not in node[1]:
                        node[1].add(i)
                        for to, parent in node[0]:
                            key = (to, id(parent), i)
                            if key not in done:
                                done.add(key)
                                work.append((to, parent, i))
                    break
                back = slot + 1
                if x.__class__ is _Loop:
                    key = (back, id(node), i)
                    if key not in done:
                        done.add(key)
                        work.append((back, node, i))
                    back = slot
                    x = x.body
                    if x.__class__ is _Term:
                        if x[s[i]]:
                            i += 1
                            continue
                        if i > far:
                            far = i
                        break
                if x.__class__ is int:
                    c = s[i]
                    alts = self.predicted[x].get(c)
                    if alts is None:
                        alts = predict(x, c)
                    if not alts:
                        if i > far:
                            far = i
                        break
                    child = nodes.get(x * (n + 1) + i)
                    if child is None:
                        nodes[x * (n + 1) + i] = child = ([(back, node)], set())
                        for a in alts:
                            work.append((a, child, i))
                    elif not any(b == back and p is node for b, p in child[0]):
                        child[0].append((back, node))
                        for j in tuple(child[1]):
                            key = (back, id(node), j)
                            if key not in done:
                                done.add(key)
                                work.append((back, node, j))
                    break
                if x is _NL:
                    if not ord(s[i]) & 1:
                        if i > far:
                            far = i
                        break
                    slot += 1
                elif x[s[i]]:
                    i += 1
                    slot += 1
                else:
                    if i > far:
                        far = i
                    break
        found = {nt for nt, r in roots.items() if n in r[1]}
        self.far = n if found else far
        return found

    def _way(self, nt: int, s: str) -> int:
        """-1 if ``nt`` derives ``s`` up to its last character, else how far any way leads."""
        if (r := self.memo[nt].get(s)) is None:
            self._keep(len(s))
            if (r := self.memo_before[nt].get(s)) is None:
                r = self._opening(nt, s[:_OPENING]) if len(s) > _OPENING + 1 else _OPENING
                if r >= _OPENING:
                    r = -1 if nt in self.recognise((nt,), s) else self.far
            self.memo[nt][s] = r
        return r

    def _keep(self, length: int) -> None:
        """Make room for one entry: a full half becomes the older one, whose entries come back when they are used."""
        self.held += _ENTRY + 4 * length
        if self.held > _MEMO // 2:
            self.held = 0
            self.memo_before, self.memo = self.memo, defaultdict(dict)
            self.shapes_before, self.shapes = self.shapes, defaultdict(dict)
            self.openings.clear()

    def _opening(self, nt: int, s: str) -> int:
        """How far any way leads through the first tokens: they are few, and tell most wrong symbols."""
        key = (nt, s)
        if (r := self.openings.get(key)) is None:
            self.recognise((nt,), s + "\x02")
            r = self.openings[key] = self.far
        return r

    def derives(self, nt: int, s: str) -> bool:
        """Whether ``nt`` derives ``s``."""
        way = self._way
        if nt in self.elements and len(s) > 12:
            element, trailing, pure = self.elements[nt]
            parts = self.comma.split(s)
            if pure and parts[0] and 0 <= way(element, parts[0] + "\x01") < len(parts[0]):
                return False  # no way leads through the first element
            if trailing and not parts[-1]:
                parts.pop()
            if len(parts) > 1:
                if all(p and way(element, p + "\x01") < 0 for p in parts):
                    return True
        elif nt in self.statements and len(s) > 12:
            parts, last = self.statements[nt]
            at, n, k = 0, len(s), 0
            while at < n:
                to = self.piece.match(s, at).end()
                for _ in range(6):
                    if to == n:
                        break
                    piece = s[at:to] + ("\x01" if ord(s[to]) & 1 else "\x02")
                    ways = [way(p, piece) for p in parts[k:]]
                    if min(ways) < 0:
                        k += next(i for i, w in enumerate(ways) if w < 0)
                        break
                    if not at and len(parts) == 1 and ways[0] < to and parts[0] == nt:
                        return False  # no way leads through the beginning
                    to = self.piece.match(s, to).end()
                else:
                    to = -1
                if to < 0 or (to == n and min(way(p, s[at:] + "\x01") for p in (last[k:] or last)) >= 0):
                    break
                at = to
            else:
                return True
            if not at and to == n and last == (nt,):
                return False  # that was the whole
        return way(nt, s + "\x01") < 0

    def group(self, bracket: str, s: str, asked: int = -1) -> str:
        """The token that stands for a group around ``s``, as far as the symbols ``asked`` for go."""
        key = (bracket, asked)
        if (mask := self.shapes[key].get(s)) is None:
            self._keep(len(s))
            if (mask := self.shapes_before[key].get(s)) is None:
                mask = 0
                for nt, bit in self.inside[bracket]:
                    if bit & asked and self.derives(nt, s):
                        mask |= bit
            self.shapes[key][s] = mask
        c = self.masks.get((bracket, mask))
        if c is None:
            c = self.masks[bracket, mask] = chr(_BASE[bracket] + 2 * sum(b == bracket for b, _ in self.masks))
            self.mask_of[c] = mask
        return c

    def dialects(self, s: str) -> list[str]:
        """The dialects that accept the whole string: one run for all of them, after the piecewise one."""
        found = [d for d, nt in self.starts.items() if nt in self.statements and self.derives(nt, s)]
        if found:
            return found
        ok = self.recognise(self.starts.values(), s + "\x01")
        return [d for d, nt in self.starts.items() if nt in ok]
