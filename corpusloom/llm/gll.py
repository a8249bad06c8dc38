"""Generalised LL recognition over a graph-structured stack.

A grammar is written as text and compiled to slots. ``Grammar.accepts`` runs all start symbols (dialects)
together on one graph-structured stack and returns the set of those that derive the whole input.

Input is a string with one character per token. A bracketed group is reduced first, innermost groups before
outer ones: the group's text is recognised against every group symbol at once and replaced by one character
that stands for the set of symbols deriving it. Because a group symbol is the only rule body in which its pair
of brackets occurs, this gives the same answer as one run over the whole file, while equal groups, which code
is full of, are recognised once per process.
"""

from __future__ import annotations

import re

END = "\x00"
_META = re.compile(r"'[^']*'|\w+|:=|[=|()?*+;]")


class Rejected(Exception):
    """The input is derived by no dialect."""


class Grammar:
    """Compiled grammar.

    Grammar text: ``Name = alternatives ;``. ``'x'`` is a literal token, upper-case names are token classes.
    ``Name := '(' ... ')' ;`` declares a group symbol: a rule whose first and last token are a pair of brackets.
    """

    MEMO_LIMIT = 400_000
    #: tokens at the start of a group by which symbols are ruled out
    PREFIX = 6
    #: if set, only groups of these symbols end a piece
    SUITES: frozenset = frozenset()

    def __init__(self, text: str, classes: list[str], starts: list[str], lists: dict[str, str], split: str | None = None):
        """lists: group symbol -> the repeated nonterminal it holds, so that its contents may be tried piecewise."""
        self.starts = starts
        self.rules: dict[str, list[list[str]]] = {}
        self.groups: dict[str, tuple[str, str]] = {}
        self.lists = lists
        self._aux = 0
        self._read(text)
        literals = sorted({s[1:-1] for alts in self.rules.values() for a in alts for s in a if s[0] == "'"})
        self.char = {t: chr(0x100 + k) for k, t in enumerate(dict.fromkeys([*literals, *classes]))}
        self.brackets = {b: self.char.setdefault(b, chr(0x100 + len(self.char))) for b in "()[]{}"}
        self.split = None
        if split:  # <x> in the pattern stands for the character of token x, @ for those of reduced {} groups
            pattern = re.sub(r"<([^<> ]+?)>", lambda m: re.escape(self.char[m[1]]), split)
            self.split = re.compile(pattern.replace("@", "\U00020000-\U00027fff"), re.S)
        self._compile()
        opens, closes = "".join(self.brackets[b] for b in "([{"), "".join(self.brackets[b] for b in ")]}")
        self._inner = re.compile(f"[{opens}][^{opens}{closes}]*[{closes}]")
        self._any_bracket = re.compile(f"[{opens}{closes}]")
        self._pair = {self.brackets[a]: self.brackets[b] for a, b in ("()", "[]", "{}")}
        self.by_open = {self.brackets[b]: [g for g, (o, _) in self.groups.items() if o == b] for b in "([{"}
        self._compound: dict[frozenset, str] = {}
        self._memo: dict[str, str] = {}
        self._pieces: dict[str, frozenset] = {}
        self._begins: dict[tuple, list] = {}
        self._files: dict[str, frozenset] = {}

    # -- grammar text ----------------------------------------------------------------------------------------
    def _read(self, text: str) -> None:
        toks = _META.findall(re.sub(r"#.*", "", text))
        i = 0
        while i < len(toks):
            name, eq = toks[i], toks[i + 1]
            i += 2
            alts, i = self._alts(toks, i)
            if toks[i] != ";":
                raise ValueError(f"grammar near {toks[i - 3 : i + 3]}")
            i += 1
            if eq == ":=":
                for a in alts:
                    if a[0] not in ("'('", "'['", "'{'"):
                        raise ValueError(f"group {name} must open with a bracket")
                self.groups[name] = (alts[0][0][1], alts[0][-1][1])
                self.rules[name + "__body"] = [a[1:-1] for a in alts]
            else:
                self.rules.setdefault(name, []).extend(alts)

    def _alts(self, toks: list[str], i: int) -> tuple[list[list[str]], int]:
        alts: list[list[str]] = [[]]
        while toks[i] not in (")", ";"):
            t = toks[i]
            if t == "|":
                alts.append([])
                i += 1
                continue
            if t == "(":
                inner, i = self._alts(toks, i + 1)
                i += 1
                sym = self._fresh(inner) if len(inner) > 1 or len(inner[0]) != 1 else inner[0][0]
            else:
                sym, i = t, i + 1
            if i < len(toks) and toks[i] in ("?", "*", "+"):
                op, i = toks[i], i + 1
                if op == "?":
                    sym = self._fresh([[sym], []])
                else:
                    loop = self._fresh([])
                    self.rules[loop] = [[sym, loop], []]
                    if op == "+":
                        alts[-1].append(sym)
                    sym = loop
            alts[-1].append(sym)
        return alts, i

    def _fresh(self, alts: list[list[str]]) -> str:
        self._aux += 1
        self.rules[f"_{self._aux}"] = alts
        return f"_{self._aux}"

    # -- tables ----------------------------------------------------------------------------------------------
    def _compile(self) -> None:
        self.nt = {n: k for k, n in enumerate(self.rules)}
        self.match: dict[str, set] = {}
        for alts in self.rules.values():
            for a in alts:
                for s in a:
                    if s not in self.nt and s not in self.match:
                        if s in self.groups:
                            self.match[s] = set()
                        elif s[0] == "'":
                            self.match[s] = {self.char[s[1:-1]]}
                        elif s in self.char:
                            self.match[s] = {self.char[s]}
                        else:
                            raise ValueError(f"unknown symbol {s}")
        nullable: set[str] = set()
        first: dict[str, set] = {n: set() for n in self.rules}
        follow: dict[str, set] = {n: set() for n in self.rules}
        changed = True
        while changed:
            changed = False
            for n, alts in self.rules.items():
                for a in alts:
                    before = len(first[n]), n in nullable
                    for s in a:
                        if s in self.nt:
                            first[n] |= first[s]
                            if s not in nullable:
                                break
                        else:
                            first[n].add(s)
                            break
                    else:
                        nullable.add(n)
                    changed |= before != (len(first[n]), n in nullable)
        changed = True
        while changed:
            changed = False
            for n, alts in self.rules.items():
                for a in alts:
                    tail = set(follow[n])
                    for s in reversed(a):
                        if s in self.nt:
                            if not tail <= follow[s]:
                                follow[s] |= tail
                                changed = True
                            tail = (tail | first[s]) if s in nullable else set(first[s])
                        else:
                            tail = {s}
        #: slots: kind 0 end of a rule, 1 token, 2 nonterminal
        self.kind: list[int] = []
        self.sym: list = []
        self.select: list[list[tuple[int, set, bool]]] = []
        for n, alts in self.rules.items():
            row = []
            for a in alts:
                sel: set[str] = set()
                null = True
                for s in a:
                    sel |= first[s] if s in self.nt else {s}
                    if s not in self.nt or s not in nullable:
                        null = False
                        break
                if null:
                    sel |= follow[n]
                row.append((len(self.kind), sel, null))
                for s in a:
                    self.kind.append(2 if s in self.nt else 1)
                    self.sym.append(self.nt[s] if s in self.nt else self.match[s])
                self.kind.append(0)
                self.sym.append(None)
            self.select.append(row)
        self._predict: list[dict[str, list[int]]] = [{} for _ in self.rules]

    def _alternatives(self, nt: int, ch: str) -> list[int]:
        found = [at for at, sel, null in self.select[nt] if (null and ch == END) or any(ch in self.match[s] for s in sel)]
        self._predict[nt][ch] = found
        return found

    # -- recognition -----------------------------------------------------------------------------------------
    def recognise(self, symbols: list[str], text: str) -> frozenset:
        """The symbols among those given that derive the whole text; one run for all of them."""
        n, w, reach = len(text), text + END, 0
        kind, sym, predict = self.kind, self.sym, self._predict
        nodes: dict[tuple[int, int], tuple[list, set, dict]] = {}
        work: list[tuple[int, tuple, int]] = []
        roots = {}
        for s in symbols:
            k = self.nt[s]
            if (k, 0) not in nodes:
                node = nodes[k, 0] = ([], set(), {})
                for at in predict[k].get(w[0]) or self._alternatives(k, w[0]):
                    work.append((at, node, 0))
            roots[s] = nodes[k, 0]
        while work:
            slot, u, i = work.pop()
            while kind[slot] == 1 and w[i] in sym[slot]:
                i += 1
                slot += 1
            if i > reach:
                reach = i
            what = kind[slot]
            if what == 2:
                k = sym[slot]
                v = nodes.get((k, i))
                if v is None:
                    v = nodes[k, i] = ([(slot + 1, u)], set(), {(slot + 1, id(u)): 1})
                    row = predict[k]
                    ch = w[i]
                    for at in row[ch] if ch in row else self._alternatives(k, ch):
                        work.append((at, v, i))
                elif (slot + 1, id(u)) not in v[2]:
                    v[2][slot + 1, id(u)] = 1
                    v[0].append((slot + 1, u))
                    for p in v[1]:
                        work.append((slot + 1, u, p))
            elif what == 0 and i not in u[1]:
                u[1].add(i)
                for back, up in u[0]:
                    work.append((back, up, i))
        self._reach = reach
        return frozenset(s for s, node in roots.items() if n in node[1])

    def _piecewise(self, bodies: dict[str, str], content: str) -> frozenset:
        """Symbols whose repeated item derives every piece of the content. bodies: symbol -> repeated nonterminal."""
        left = frozenset(bodies)
        wanted = sorted(set(bodies.values()))
        for piece in self.split.findall(content):
            got = self._pieces.get(piece)
            if got is None:
                if len(self._pieces) > self.MEMO_LIMIT:
                    self._pieces.clear()
                got = self._pieces[piece] = self.recognise(wanted, piece)
            left = frozenset(s for s in left if bodies[s] in got)
            if not left:
                break
        return left

    def _derive(self, symbols: list[str], bodies: dict[str, str], content: str) -> frozenset:
        lists = {s: self.lists[s] for s in symbols if s in self.lists}
        got = self._piecewise(lists, content) if lists and self.split and content else frozenset()
        rest = [s for s in symbols if s not in got]
        if got:  # pieces end where items of any list end, so a list refuted by pieces is refuted
            rest = [s for s in rest if s not in lists]
        rest = self._viable(rest, bodies, content[: self.PREFIX])
        if rest:
            found = self.recognise([bodies[s] for s in rest], content)
            got = got | {s for s in rest if bodies[s] in found}
        return frozenset(got)

    def _viable(self, symbols: list[str], bodies: dict[str, str], piece: str) -> list[str]:
        """The symbols of which the piece can be the beginning; what can't begin so need not be tried on the whole."""
        if not symbols:
            return symbols
        key = (tuple(symbols), piece)
        got = self._begins.get(key)
        if got is None:
            if len(self._begins) > self.MEMO_LIMIT:
                self._begins.clear()
            got = self._begins[key] = [s for s in symbols if self.begins(bodies[s], piece)]
        return got

    def begins(self, symbol: str, text: str) -> bool:
        """Whether some text that begins with the given one may be derived by the symbol."""
        self._reach = 0
        self.recognise([symbol], text)
        return self._reach >= len(text)

    def _group(self, m: re.Match) -> str:
        text = m.group()
        got = self._memo.get(text)
        if got is None:
            if len(self._memo) > self.MEMO_LIMIT:
                self._memo.clear()
            if self._pair[text[0]] != text[-1]:
                raise Rejected
            symbols = self.by_open[text[0]]
            found = self._derive(symbols, {s: s + "__body" for s in symbols}, self.inside(text[1:-1]))
            if not found:
                raise Rejected
            got = self._memo[text] = self._stand_in(found)
        return got

    def _stand_in(self, found: frozenset) -> str:
        ch = self._compound.get(found)
        if ch is None:
            base = {"(": 0x10000, "[": 0x18000, "{": 0x20000}[self.groups[next(iter(found))][0]]
            if self.SUITES and not self.SUITES & found:
                base = 0x10000
            ch = self._compound[found] = chr(base + len(self._compound))
            for s in found:
                if s in self.match:
                    self.match[s].add(ch)
        return ch

    def inside(self, content: str) -> str:
        """Hook for a language in which brackets change what counts as a token."""
        return content

    def reduce(self, text: str) -> str:
        """Every bracketed group replaced by the character of its symbols; raises Rejected if one has none."""
        while True:
            text, n = self._inner.subn(self._group, text)
            if not n:
                break
        if self._any_bracket.search(text):
            raise Rejected
        return text

    def accepts(self, text: str) -> frozenset:
        """The start symbols (dialects) that derive the token string; empty means every dialect rejects it."""
        try:
            flat = self.reduce(text)
        except Rejected:
            return frozenset()
        return self.accepts_flat(flat)

    def accepts_flat(self, flat: str) -> frozenset:
        """As accepts, for a string without brackets."""
        got = self._files.get(flat)
        if got is None:
            if len(self._files) > self.MEMO_LIMIT // 10:
                self._files.clear()
            got = self._files[flat] = self._derive(self.starts, {s: s for s in self.starts}, flat)
        return got
