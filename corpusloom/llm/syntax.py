"""Lexers that turn file text into token strings, and the syntax check per language.

``valid(language, text)`` is true if any dialect of the language derives the whole text.
"""

from __future__ import annotations

import functools
import re

from corpusloom.llm import grammars as G
from corpusloom.llm.gll import Grammar, Rejected

#: content_type -> language. Fixed values of the data model.
LANGUAGE_OF_TYPE = {
    "java": "java", "python": "python", "go": "go", "typescript": "typescript", "javascript": "javascript",
    "bash": "bash", "spring_yaml": "yaml", "maven": "xml", "openapi": "json",
}
LANGUAGE_OF_NAME = {
    "java": "java", "py": "python", "pyi": "python", "go": "go", "ts": "typescript", "tsx": "typescript", "mts": "typescript",
    "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "sh": "bash", "bash": "bash",
    "yml": "yaml", "yaml": "yaml", "xml": "xml", "json": "json",
}
_CACHE_LIMIT = 300_000


def language(content_type: str | None, rel_path: str | None) -> str | None:
    """The language a file claims to be in: by its content type, by its file name where that is null."""
    if content_type is not None:
        return LANGUAGE_OF_TYPE.get(content_type)
    return LANGUAGE_OF_NAME.get((rel_path or "").rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower())


class Lexer:
    """Tokens by one regular expression; ``kinds`` caches the character of each distinct token."""

    def __init__(self, grammar: Grammar, rx: str, words: set[str], name: str = "ID"):
        self.g, self.rx = grammar, re.compile(rx, re.S)
        self.cache: dict[str, str] = {}
        self.words, self.name = words, name

    def kind(self, t: str) -> str:
        raise NotImplementedError

    def chars(self, text: str) -> list[str]:
        cache, kind = self.cache, self.kind
        if len(cache) > _CACHE_LIMIT:
            cache.clear()
        out = []
        for t in self.rx.findall(text):
            c = cache.get(t)
            if c is None:
                c = kind(t)
                if len(t) < 60:
                    cache[t] = c
            out.append(c)
        return out


_NUM = r"(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)"


class Java(Lexer):
    STARTS = ["Java17", "Java8", "Module"]
    RESERVED = {"goto", "const", "_"}

    def __init__(self):
        g = _java_grammar()
        words = {t for t in g.char if t.isalpha()}
        rx = (
            r'//[^\n]*|/\*.*?\*/|"""(?:[^\\]|\\.)*?"""|"(?:[^"\\\n]|\\.)*"|' + r"'(?:[^'\\\n]|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\.)'|"
            + _NUM + r"[lLfFdD]?\w*|[^\W\d][\w$]*|\$[\w$]*|>>>=|>>=|>=|<<=|\.\.\.|->|::|\+\+|--|&&|\|\||[=!<+\-*/%&|^]=|<<|[^\s]"
        )
        super().__init__(g, rx, words)

    def kind(self, t: str) -> str:
        c = t[0]
        char = self.g.char
        if t[:2] in ("//", "/*") and (c + t[1] == "//" or len(t) >= 4 and t.endswith("*/")):
            return ""
        if c in "\"'":
            return char["STR"] if len(t) > 1 else "\x01"
        if c.isdigit() or c == "." and len(t) > 1 and t[1].isdigit():
            return char["NUM"] if re.fullmatch(_NUM + "[lLfFdD]?", t) else "\x01"
        if t in char and t not in ("ID", "NUM", "STR"):
            return char[t]
        if t in (">>>=", ">>="):
            return char[">"] * (len(t) - 2) + char[">="]
        if c.isalpha() or c in "_$":
            return "\x01" if t in self.RESERVED else char["ID"]
        return "\x01"

    def valid(self, text: str) -> bool:
        s = "".join(self.chars(text))
        return "\x01" not in s and bool(self.g.accepts(s))


def _java_grammar() -> Grammar:
    text = G.JAVA + "\n_Stmts = Stmt* ; _Members = Member* ;"
    split = r"(?:[^<;>@]|[@](?=<else>|<catch>|<finally>|<while>|<;>|<,>|<.>))*(?:<;>|[@])|[^<;>@]+"
    return Grammar(text, ["ID", "NUM", "STR"], Java.STARTS, {"Block": "_Stmts", "ClassBody": "_Members"}, split)


class Go(Lexer):
    def __init__(self):
        text = G.GO + "\n_Lines = Line* Stmt? ; _FileTop = Top* ;"
        split = r"(?:<if>|<for>|<switch>)[^@]*(?:[@](?!<;>)[^@]*)*[@]<;>|[^<;>]*<;>|[^<;>]+"
        g = Grammar(text, ["ID", "NUM", "STR"], ["File"], {"Block": "_Lines"}, split)
        rx = (
            r'//[^\n]*|/\*.*?\*/|`[^`]*`|"(?:[^"\\\n]|\\.)*"|' + r"'(?:[^'\\\n]|\\[^\n']+|\\')'|\n|"
            + _NUM + r"i?\w*|[^\W\d]\w*|<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|:=|[=!<>+\-*/%&|^]=|<<|>>|&\^|[^\s]"
        )
        super().__init__(g, rx, set())
        ch = g.char
        ends = [ch[x] for x in ("ID", "NUM", "STR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}")]
        self.semi = re.compile("([" + re.escape("".join(ends)) + "])\n+")

    def kind(self, t: str) -> str:
        c, char = t[0], self.g.char
        if t == "\n":
            return "\n"
        if t[:2] == "//":
            return ""
        if t[:2] == "/*" and len(t) >= 4 and t.endswith("*/"):
            return "\n" if "\n" in t else ""
        if c in "\"'`":
            return char["STR"] if len(t) > 1 else "\x01"
        if c.isdigit() or c == "." and len(t) > 1 and t[1].isdigit():
            return char["NUM"] if re.fullmatch(_NUM + "i?", t) else "\x01"
        if t in char and t not in ("ID", "NUM", "STR"):
            return char[t]
        if c.isalpha() or c == "_":
            return char["ID"]
        return "\x01"

    def valid(self, text: str) -> bool:
        s = "".join(self.chars(text)) + "\n"
        if "\x01" in s:
            return False
        s = self.semi.sub(lambda m: m[1] + self.g.char[";"], s).replace("\n", "")
        return bool(self.g.accepts(s))


class _EcmaGrammar(Grammar):
    """Line ends matter in statement lists only, so a {} group is read both ways."""

    STATEMENTS = {"Block", "ClassB", "SwB", "NsBody", "ObjT"}
    NL = "\x02"

    def _derive(self, symbols, bodies, content):
        if self.NL not in content and not (symbols and symbols[0] in self.groups and self.groups[symbols[0]][0] == "{") and symbols != self.starts:
            return super()._derive(symbols, bodies, content)
        a = [s for s in symbols if s in self.STATEMENTS or s in self.starts]
        b = [s for s in symbols if s not in a]
        got = frozenset()
        if b:
            flat = content.replace(self.NL, "")
            b = self._viable(b, bodies, flat[: self.PREFIX])
            got |= super()._derive(b, bodies, flat) if b else got
        if a:
            semi = self.char[";"]
            text = content.replace(self.NL, semi)
            if text and text[-1] != semi and not "\U00020000" <= text[-1] <= "\U00027fff":
                text += semi
            elif text and text[-1] != semi:
                got |= super()._derive(a, bodies, text)
                a = [s for s in a if s not in got]
                text += semi
            if a:
                got |= super()._derive(a, bodies, text)
        return frozenset(got)


def _holes(t: str) -> list[str]:
    """The texts of the ${...} of a template literal."""
    found, i = [], 1
    while i < len(t) - 1:
        if t[i] == "\\":
            i += 2
        elif t.startswith("${", i):
            j = _hole_end(t, i + 2)
            found.append(t[i + 2 : j])
            i = j + 1
        else:
            i += 1
    return found


def _hole_end(t: str, j: int) -> int:
    depth = 0
    while j < len(t) and (depth or t[j] != "}"):
        c = t[j]
        if c in "\"'" and (m := re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'").match(t, j)):
            j = m.end()
        elif c == "`":
            j += 1
            while j < len(t) and t[j] != "`":
                j = j + 2 if t[j] == "\\" else _hole_end(t, j + 2) + 1 if t.startswith("${", j) else j + 1
            j += 1
        else:
            depth += {"{": 1, "}": -1}.get(c, 0)
            j += 1
    return j


class Ecma(Lexer):
    _OPS = r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*"

    #: behind these a slash begins a regular expression
    _BEFORE = r"=>|&&|\|\||\?\?|===?|!==?|[(,=:\[!&|?{};+\-*%~^]|\b(?:return|typeof|case|void|delete|throw|else|do|yield|await)\b"

    def __init__(self, typed: bool):
        self.typed = typed
        text = G.ecma(typed) + "\n_Stmts = Stmt* ; _Members = Member* ; _Items = Item* ;"
        split = r"(?:[^<;>@]|[@](?=<else>|<catch>|<finally>|<while>|<;>|<,>|<.>|<=>|<from>|<instanceof>))*(?:<;>|[@])|[^<;>@]+"
        lists = {"Block": "_Stmts", "ClassB": "_Members", "File": "_Items"} | ({"NsBody": "_Items"} if typed else {})
        g = _EcmaGrammar(text, ["ID", "NUM", "STR", "TPL", "REGEX", "PRIV", "KW"], ["File"], lists, split)
        regex = r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*"
        ops = self._OPS if not typed else self._OPS.replace(r">>>=|", "").replace(r">>=|>>>|", "").replace(r"<=|>=", "<=|>=").replace(r"<<|>>|", "<<|")
        rx = (
            r"//[^\n]*|/\*.*?\*/|`(?:[^`\\$]|\\.|\$(?!\{)|\$\{(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*\})*`|" + r'"(?:[^"\\\n]|\\.)*"|' + r"'(?:[^'\\\n]|\\.)*'|"
            + "(?:" + self._BEFORE + r")[ \t]*" + regex + r"|\n\s*" + regex + r"|\n|" + _NUM + r"n?\w*|[^\W\d][\w$]*|\$[\w$]*|\#[^\W\d][\w$]*|" + ops + r"|[^\s]"
        )
        super().__init__(g, rx, set())
        ch = g.char
        first = [ch[x] for x in ("ID", "NUM", "STR", "TPL", "REGEX", "PRIV", "KW", ")", "]", "}", "++", "--", "this", "super", "null", "true", "false", "return", "break", "continue", "debugger", "async", "of", "get", "set", "from", "as", "type", "declare", "abstract", "readonly", "namespace", "interface", "is") if x in ch]
        stop = [ch[x] for x in (".", "?.", "(", "[", "+", "-", "*", "/", "%", ",", ";", "?", ":", "=", "=>", "==", "===", "!=", "!==", "<", ">", "<=", ">=", "&&", "||", "??", "&", "|", "^", "+=", "-=", "in", "instanceof", "else", "catch", "finally", "while", "}", ")", "]", "TPL", "{", "as", "satisfies") if x in ch]
        # a line end before else or while ends the statement there, unless a block has just ended
        self.nl = re.compile("(?<=[" + re.escape("".join(first)) + "])\n+(?![" + re.escape("".join(stop)) + "])|(?<=[" + re.escape("".join(x for x in first if x != ch["}"])) + "])\n+(?=[" + re.escape(ch["else"] + ch["while"]) + "])")
        self.words = {"KW": set()}

    def kind(self, t: str) -> str:
        c, char = t[0], self.g.char
        if c == "\n":
            return "\n" if t == "\n" else "\n" + char["REGEX"]
        if t[:2] == "//":
            return ""
        if t[:2] == "/*" and len(t) >= 4 and t.endswith("*/"):
            return "\n" if "\n" in t else ""
        if c in "\"'":
            return char["STR"] if len(t) > 1 else "\x01"
        if c == "`":
            return char["TPL"] if len(t) > 1 and all(map(self._hole, _holes(t))) else "\x01"
        if c.isdigit() or c == "." and len(t) > 1 and t[1].isdigit():
            return char["NUM"] if re.fullmatch(_NUM + "n?", t) else "\x01"
        if t in char and t not in ("ID", "NUM", "STR", "TPL", "REGEX", "PRIV", "KW"):
            return char[t]
        if "/" in t and (m := re.match(self._BEFORE, t)) and m.group() in char:
            return char[m.group()] + char["REGEX"]
        if c.isalpha() or c in "_$":
            return char["ID"]
        if c == "#" and len(t) > 1:
            return char["PRIV"]
        return "\x01"

    def _hole(self, inner: str) -> bool:
        """The text of ${...} must be an expression; a bracket that closes one outside fits only one of two kinds of brackets."""
        return self.valid(f"({inner}\n);") and (")" not in inner or self.valid(f"a[{inner}\n];"))

    def valid(self, text: str) -> bool:
        if text.startswith("#!"):
            text = text.partition("\n")[2]
        s = "".join(self.chars(text))
        if "\x01" in s:
            return False
        s = self.nl.sub(_EcmaGrammar.NL, s).replace("\n", "")
        return bool(self.g.accepts(s))


class _PyGrammar(Grammar):
    """Line ends and indentation do not count inside brackets; a {} group is a suite if it holds line ends."""

    LAYOUT = re.compile("[\x02-\x03-]")

    SUITES = frozenset(("Body", "Cases"))

    def inside(self, content: str) -> str:
        return self.LAYOUT.sub("", content)


class Python(Lexer):
    KEYWORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()

    def __init__(self):
        text = G.PYTHON + "\n_LinesN = LineN* ;"
        split = r"(?:[^<NL>@]|[@](?=<else>|<elif>|<except>|<finally>)|<NL>(?=[@]))*(?:<NL>|[@])|[^<NL>@]+"
        self.g = g = _PyGrammar(text, ["ID", "NUM", "STR", "NL", "_"], ["Py312", "Py36"], {"Body": "_LinesN", "Py312": "_LinesN"}, split)
        rx = (
            r"#[^\n]*|(?:[rRbBuUfF]{0,2})(?:'''(?:[^\\]|\\.)*?'''|\"\"\"(?:[^\\]|\\.)*?\"\"\"|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\")|\\\n|\n[ \t\f]*|"
            + _NUM + r"[jJ]?\w*|[^\W\d]\w*|\*\*=|//=|>>=|<<=|\.\.\.|->|:=|==|!=|<=|>=|\*\*|//|<<|>>|[+\-*/%@&|^]=|[^\s]"
        )
        super().__init__(g, rx, set(self.KEYWORDS))
        self.nl = g.char["NL"]
        #: widths of an indentation with tabs of 8 and of 1
        self.indents: dict[tuple[int, int], int] = {}

    def _field(self, t: str, i: int, depth: int = 0) -> int:
        """The position after the replacement field that opens at i; -1 if it is no field."""
        j, stack, quote = i + 1, [], re.compile(r"'''.*?'''|\"\"\".*?\"\"\"|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"", re.S)
        while j < len(t):
            c = t[j]
            if c in "\"'" and (m := quote.match(t, j)):
                j = m.end()
                continue
            if c in "([{":
                stack.append(")]}"["([{".index(c)])
            elif stack and c == stack[-1]:
                stack.pop()
            elif c in ")]" or c == "}" and stack:
                return -1
            elif not stack and (c in "}:" or c == "!" and t[j + 1 : j + 2] != "="):
                break
            j += 1
        expr = t[i + 1 : j]
        expr = re.sub(r"(?<![=!<>])=\s*$", "", expr)
        if j >= len(t) or not expr.strip() or depth > 3 or not self.valid(f"({expr}\n)\n"):
            return -1
        if t[j] == "!":
            m = re.compile(r"!\s*[sra]\s*(?=[:}])").match(t, j)
            if not m:
                return -1
            j = m.end()
        if t[j] == ":":
            j += 1
            while j < len(t) and t[j] != "}":
                j = self._field(t, j, depth + 1) if t[j] == "{" else j + 1
                if j < 0:
                    return -1
        return j + 1 if j < len(t) else -1

    def _fstring(self, t: str) -> bool:
        """Whether each {...} of an f-string holds an expression, and no brace stands alone."""
        m = re.match(r"(\w*)('''|\"\"\"|'|\")", t)
        raw, body = "r" in m.group(1).lower(), t[m.end() : len(t) - len(m.group(2))]
        i = 0
        while i < len(body):
            c = body[i]
            if c == "\\" and not raw:
                n = re.compile(r"\\N\{[^{}]*\}").match(body, i)
                i = n.end() if n else i + 1 + (body[i + 1 : i + 2] not in ("{", "}"))
            elif body.startswith(("{{", "}}"), i):
                i += 2
            elif c == "}":
                return False
            elif c == "{":
                i = self._field(body, i)
                if i < 0:
                    return False
            else:
                i += 1
        return True

    def kind(self, t: str) -> str:
        c, char = t[0], self.g.char
        if c == "\n":
            blanks = t[1:].replace("\f", "")
            return "\x02" + chr(0xE000 + self.indents.setdefault((len(blanks.expandtabs(8)), len(blanks)), len(self.indents)))
        if c == "#" or t == "\\\n":
            return ""
        if t in char and t not in ("ID", "NUM", "STR", "NL"):
            return char[t]
        if t[-1] in "\"'":
            if "{" in t or "}" in t:
                if "f" in re.match(r"\w*", t).group().lower() and not self._fstring(t):
                    return "\x01"
            return char["STR"] if len(t) > 1 else "\x01"
        if c.isdigit() or c == "." and len(t) > 1 and t[1].isdigit():
            if not re.fullmatch(_NUM + "[jJ]?", t) or re.fullmatch(r"0[0-9_]*[1-9][0-9_]*", t):
                return "\x01"
            return char["NUM"]
        if c.isalpha() or c == "_":
            return "\x01" if t in self.words else char["ID"]
        return "\x01"

    def valid(self, text: str) -> bool:
        text = text.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n")
        if len(self.indents) > 3000:
            self.indents.clear()
            self.cache.clear()
        s = "".join(self.chars("\n" + text))
        if "\x01" in s or "\x00" in text:
            return False
        g = self.g
        try:
            s = g.reduce(s)
        except Rejected:
            return False
        widths = list(self.indents)
        out, stack = [], [(0, 0)]
        for line in s.split("\x02")[1:]:
            body = line[1:]
            if not body:
                continue
            indent = widths[ord(line[0]) - 0xE000]
            if indent[0] > stack[-1][0]:
                if indent[1] <= stack[-1][1]:
                    return False
                stack.append(indent)
                out.append(g.brackets["{"])
            while indent[0] < stack[-1][0]:
                stack.pop()
                out.append(g.brackets["}"])
            if indent != stack[-1]:
                return False
            out.append(body + self.nl)
        out.append(g.brackets["}"] * (len(stack) - 1))
        try:
            return self._blocks("".join(out))
        except Rejected:
            return False

    def _blocks(self, s: str) -> bool:
        g = self.g
        s = g.reduce(s)
        return bool(g.accepts_flat(s)) if s else True


class Json(Lexer):
    def __init__(self):
        g = Grammar(G.JSON, ["NUM", "STR"], ["Json"], {}, None)
        rx = r'"(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|\w+|[^ \t\r\n]'
        super().__init__(g, rx, set())

    def kind(self, t: str) -> str:
        char = self.g.char
        if t in char and t not in ("NUM", "STR"):
            return char[t]
        if t[0] == '"':
            return char["STR"] if len(t) > 1 else "\x01"
        if t[0].isdigit() or t[0] == "-" and len(t) > 1:
            return char["NUM"] if re.fullmatch(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?", t) else "\x01"
        return "\x01"

    def valid(self, text: str) -> bool:
        s = "".join(self.chars(text))
        return "\x01" not in s and bool(self.g.accepts(s))


class Xml:
    _TOKEN = re.compile(
        r"<!--(?P<com>(?:(?!--).)*)-->|<!\[CDATA\[.*?\]\]>|<\?(?P<pi>[^\s?]+)(?:\s.*?)?\?>|<!DOCTYPE(?P<dt>(?:[^<>\[\"']|\"[^\"]*\"|'[^']*'|\[(?:[^\]\"']|\"[^\"]*\"|'[^']*')*\])*)>"
        r"|</(?P<end>[\w:.\-]+)\s*>|<(?P<start>[^\W\d][\w:.\-]*)(?P<attrs>(?:\s+[^\W\d][\w:.\-]*\s*=\s*(?:\"[^<\"]*\"|'[^<']*'))*)\s*(?P<empty>/?)>|(?P<text>[^<]+)",
        re.S,
    )
    _REF = re.compile(r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+);)")
    _ATTR = re.compile(r"([\w:.\-]+)\s*=")

    def __init__(self):
        self.g = Grammar(G.XML, ["DECL", "DOCTYPE", "EMPTY", "COMMENT", "PI", "WS", "TEXT", "CDATA"], ["Doc"], {}, None)

    def valid(self, text: str) -> bool:
        text = text.lstrip("﻿")
        ch, out, names, at = self.g.char, [], [], 0
        for m in self._TOKEN.finditer(text):
            if m.start() != at:
                return False
            at = m.end()
            kind, t = m.lastgroup, m.group()
            if m["text"] is not None:
                if "]]>" in t or self._REF.search(t) or re.search("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", t):
                    return False
                out.append(ch["WS"] if not t.strip(" \t\r\n") else ch["TEXT"])
            elif m["start"]:
                a = m["attrs"]
                if a:
                    found = self._ATTR.findall(re.sub(r"\"[^\"]*\"|'[^']*'", "", a))
                    if len(set(found)) != len(found) or self._REF.search(a):
                        return False
                if m["empty"]:
                    out.append(ch["EMPTY"])
                else:
                    names.append(m["start"])
                    out.append(self.g.brackets["{"])
            elif m["end"]:
                if not names or names.pop() != m["end"]:
                    return False
                out.append(self.g.brackets["}"])
            elif m["com"] is not None:
                out.append(ch["COMMENT"])
            elif m["pi"]:
                if m["pi"].lower() == "xml":
                    if m.start():
                        return False
                    out.append(ch["DECL"])
                else:
                    out.append(ch["PI"])
            elif m["dt"] is not None:
                out.append(ch["DOCTYPE"])
            else:
                out.append(ch["CDATA"])
            _ = kind
        return at == len(text) and not names and bool(self.g.accepts("".join(out)))


YAML = r"""
Yaml = NodeD? (DOC NodeD?)* ;
NodeD = Map | Seq | Plain | Flow NL | BLOCK | Prop+ NL (Map | Seq) ;
Node = Map | Seq | Plain | Flow NL ;
Map = Pair+ ;
Pair = KEY Prop* (NL (Sub | Seq)? | PLAIN NL More? | QUOTED NL | Flow NL | BLOCK | ALIAS NL) ;
Sub := '{' Node '}' ;
More := '{' (PLAIN NL More?)+ '}' ;
Seq = Item+ ;
Item = DASH Prop* (NL Sub? | Sub | PLAIN NL More? | QUOTED NL | Flow NL | BLOCK | ALIAS NL) ;
Plain = (PLAIN NL More?)+ | QUOTED NL ;
Prop = PROP ;
Flow = FMap | FSeq ;
FMap := '(' (FPair (',' FPair)* ','?)? ')' ;
FPair = FVal (':' FVal?)? ;
FSeq := '[' (FPair (',' FPair)* ','?)? ']' ;
FVal = PLAIN | QUOTED | ALIAS | FMap | FSeq ;
"""


class Yaml:
    """Indentation becomes {} groups; flow mappings use ( ) so that they cannot be taken for blocks."""

    _KEY = re.compile(r"(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|\?|(?:[^\s#&*!|>%@`\"'\[\]{},?:\-]|[?:\-](?=\S))(?:[^\s:#]|:(?=\S)|(?<=\S)#|[ \t]+(?![#:\s]))*)[ \t]*:(?=[ \t]|$)")
    _BLOCK = re.compile(r"[|>](?:[+-]?[1-9]?|[1-9][+-])[ \t]*(?:#.*)?$")
    _PROP = re.compile(r"(?:&[^\s,\[\]{}]+|![^\s,\[\]{}]*)(?=\s|$)")
    _FLOW = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[\[\]{},]|:(?=[\s,\[\]{}]|$)|(?<=[\"'\]}]):|(?:^|(?<=\s))#[^\n]*|\*[^\s,\[\]{}]+|[^\s,\[\]{}:\"'#](?:[^,\[\]{}:#\n]|:(?![\s,\[\]{}])|(?<=\S)#)*|\s+|.", re.S)

    def __init__(self):
        self.g = Grammar(YAML, ["DOC", "KEY", "NL", "PLAIN", "QUOTED", "BLOCK", "ALIAS", "DASH", "PROP"], ["Yaml"], {}, None)

    def valid(self, text: str) -> bool:
        try:
            return bool(self.g.accepts(self._lex(text.lstrip("﻿").replace("\r\n", "\n"))))
        except Rejected:
            return False

    def _lex(self, text: str) -> str:
        ch, br = self.g.char, self.g.brackets
        lines, out, stack, i = text.split("\n"), [], [], 0

        def level(col: int) -> None:
            while stack and stack[-1] > col:
                stack.pop()
                if stack:
                    out.append(br["}"])
            if not stack:
                stack.append(col)
            elif stack[-1] < col:
                stack.append(col)
                out.append(br["{"])

        while i < len(lines):
            line = lines[i]
            body = line.lstrip(" ")
            if not body.strip() or body.lstrip("\t").startswith("#"):
                i += 1
                continue
            if body[0] == "\t" or re.search("[\x00-\x08\x0b\x0c\x0e-\x1f]", line):
                raise Rejected
            if re.match(r"(---|\.\.\.)(\s|$)|%", line):
                while len(stack) > 1:
                    stack.pop()
                    out.append(br["}"])
                stack.clear()
                if line[0] != "%":
                    out.append(ch["DOC"])
                    if line[3:].strip() and not line[3:].lstrip().startswith("#"):
                        lines[i] = "    " + line[4:]
                        continue
                i += 1
                continue
            col = len(line) - len(body)
            level(col)
            parent = col
            while body[:2] in ("- ", "-\t") or body == "-":
                out.append(ch["DASH"])
                rest = body[1:].lstrip(" ")
                if not rest or rest.startswith("#"):
                    body = ""
                    break
                at = col + len(body) - len(rest)
                if rest[:2] == "- " or rest == "-" or self._KEY.match(rest):
                    level(at)
                    parent = at
                col, body = at, rest
            m = self._KEY.match(body)
            if m:
                out.append(ch["KEY"])
                body = body[m.end() :].lstrip(" \t")
            while body and (p := self._PROP.match(body)):
                out.append(ch["PROP"])
                body = body[p.end() :].lstrip(" \t")
            if not body or body.startswith("#"):
                out.append(ch["NL"])
                i += 1
                continue
            c = body[0]
            if self._BLOCK.match(body):
                out.append(ch["BLOCK"])
                i += 1
                while i < len(lines) and (not lines[i].strip() or len(lines[i]) - len(lines[i].lstrip(" ")) > parent):
                    i += 1
                continue
            if c == "*":
                if not re.fullmatch(r"\*[^\s,\[\]{}]+\s*(#.*)?", body):
                    raise Rejected
                out += ch["ALIAS"], ch["NL"]
                i += 1
                continue
            if c in "\"'":
                rx = r'"(?:[^"\\]|\\.)*"' if c == '"' else r"'(?:[^']|'')*'"
                tail = body
                while True:
                    q = re.match(rx, tail, re.S)
                    if q:
                        break
                    i += 1
                    if i >= len(lines) or lines[i].strip() and len(lines[i]) - len(lines[i].lstrip(" ")) <= (parent if m or parent else -1):
                        raise Rejected
                    tail += "\n" + lines[i]
                if not re.fullmatch(r"[ \t]*(?:[ \t]#.*)?", tail[q.end() :]):
                    raise Rejected
                if c == '"' and re.search(r"(?<!\\)(?:\\\\)*\\(?![0abt\tnvfre \"/\\N_LPxuU\n])", q.group()):
                    raise Rejected
                out += ch["QUOTED"], ch["NL"]
                i += 1
                continue
            if c in "[{":
                i = self._flow(lines, i, body, out)
                out.append(ch["NL"])
                continue
            if c in "@`%,]}&!|>" or (c in "?-:" and (len(body) == 1 or body[1] in " \t")):
                raise Rejected
            plain = re.split(r"[ \t]#", body)[0].rstrip()
            if re.search(r":(?:[ \t]|$)", plain):
                raise Rejected
            out += ch["PLAIN"], ch["NL"]
            i += 1
        while len(stack) > 1:
            stack.pop()
            out.append(br["}"])
        return "".join(out)

    def _flow(self, lines: list[str], i: int, body: str, out: list[str]) -> int:
        ch, br, depth = self.g.char, self.g.brackets, 0
        text = body + "".join("\n" + x for x in lines[i + 1 :])
        for t in self._FLOW.finditer(text):
            s = t.group()
            if s.isspace() or s[0] == "#":
                continue
            if s in "[{":
                depth += 1
                out.append(br["["] if s == "[" else br["("])
            elif s in "]}":
                depth -= 1
                out.append(br["]"] if s == "]" else br[")"])
                if not depth:
                    rest = text[t.end() :].split("\n", 1)[0]
                    if not re.fullmatch(r"[ \t]*(?:[ \t]#.*)?", rest):
                        raise Rejected
                    return i + text[: t.end()].count("\n") + 1
            elif s in (",", ":"):
                out.append(ch[s])
            elif s[0] in "\"'":
                if len(s) == 1:
                    raise Rejected
                out.append(ch["QUOTED"])
            elif s[0] == "*":
                out.append(ch["ALIAS"])
            elif s[0] in "@`%|>":
                raise Rejected
            else:
                out.append(ch["PLAIN"])
        raise Rejected


class _BashGrammar(Grammar):
    def inside(self, content: str) -> str:
        return content.lstrip(self.char[";;NL"])


class Bash:
    RESERVED = ["if", "then", "else", "elif", "fi", "do", "done", "case", "esac", "while", "until", "for", "select", "function", "in", "time", "!"]
    _META = set(" \t\n;&|()<>")

    def __init__(self):
        text = G.BASH + "\n_Line = (AndOr Term)+ ;"
        lists = {"Brace": "_Line", "Bash": "_Line", "Posix": "_Line"}
        self.g = _BashGrammar(text, ["WORD", "ASSIGN", "REDIR", "REDIRFD", "ARITH", "COND", "CASEPAT"], ["Bash", "Posix"], lists, "[^<;;NL>]*(?:<;;NL>)+|[^<;;NL>]+")

    def valid(self, text: str) -> bool:
        try:
            return self._accept(text.replace("\r\n", "\n"))
        except (Rejected, RecursionError):
            return False

    def _accept(self, text: str) -> bool:
        nl = self.g.char[";;NL"]
        s = self._lex(text).strip(nl)
        return not s or bool(self.g.accepts(s + nl))

    # each skip returns the position after the construct that opens at i
    def _single(self, t: str, i: int) -> int:
        j = t.find("'", i + 1)
        if j < 0:
            raise Rejected
        return j + 1

    def _double(self, t: str, i: int) -> int:
        i += 1
        while i < len(t):
            c = t[i]
            if c == '"':
                return i + 1
            if c == "\\":
                i += 2
            elif c == "$":
                i = self._dollar(t, i)
            elif c == "`":
                i = self._back(t, i)
            else:
                i += 1
        raise Rejected

    def _back(self, t: str, i: int) -> int:
        m = re.compile(r"`(?:[^`\\]|\\.)*`", re.S).match(t, i)
        if not m:
            raise Rejected
        return m.end()

    def _dollar(self, t: str, i: int) -> int:
        n = t[i + 1 : i + 2]
        if t.startswith("$((", i):
            j, depth = i + 3, 2
            while j < len(t) and depth:
                depth += {"(": 1, ")": -1}.get(t[j], 0)
                j += 1
            if depth:
                raise Rejected
            return j
        if n == "(":
            j = self._paren(t, i + 1)
            if not self._accept(t[i + 2 : j - 1]):
                raise Rejected
            return j
        if n == "{":
            j = i + 2
            while j < len(t):
                c = t[j]
                if c == "}":
                    return j + 1
                if c == "\\":
                    j += 2
                elif c == '"':
                    j = self._double(t, j)
                elif c == "'" and False:
                    j = self._single(t, j)
                elif c == "$":
                    j = self._dollar(t, j)
                elif c == "`":
                    j = self._back(t, j)
                else:
                    j += 1
            raise Rejected
        if n == "'":
            m = re.compile(r"\$'(?:[^'\\]|\\.)*'", re.S).match(t, i)
            if not m:
                raise Rejected
            return m.end()
        return i + 1

    def _paren(self, t: str, i: int) -> int:
        """i is at an open parenthesis; case patterns inside count by their own parenthesis."""
        depth, j, cases = 0, i, 0
        while j < len(t):
            c = t[j]
            if c == "\\":
                j += 2
                continue
            if c == "'":
                j = self._single(t, j)
                continue
            if c == '"':
                j = self._double(t, j)
                continue
            if c == "`":
                j = self._back(t, j)
                continue
            if c == "$" and t[j + 1 : j + 2] in ("(", "{", "'"):
                j = self._dollar(t, j)
                continue
            if c == "#" and (t[j - 1] in " \t\n;(" or j == 0):
                k = t.find("\n", j)
                j = len(t) if k < 0 else k
                continue
            if c == "c" and re.match(r"case\s", t[j : j + 5]) and t[j - 1] in " \t\n;(|&":
                cases += 1
            if c == "e" and cases and re.match(r"esac\b", t[j : j + 5]) and t[j - 1] in " \t\n;":
                cases -= 1
            if c == "(":
                depth += 1
            elif c == ")":
                if cases and depth == 1:
                    j += 1
                    continue
                depth -= 1
                if not depth:
                    return j + 1
            j += 1
        raise Rejected

    def _word(self, t: str, i: int) -> int:
        while i < len(t):
            c = t[i]
            if c == "\\":
                i += 2
            elif c == "'":
                i = self._single(t, i)
            elif c == '"':
                i = self._double(t, i)
            elif c == "`":
                i = self._back(t, i)
            elif c == "$":
                i = self._dollar(t, i)
            elif c in "<>" and t[i + 1 : i + 2] == "(":
                j = self._paren(t, i + 1)
                if not self._accept(t[i + 2 : j - 1]):
                    raise Rejected
                i = j
            elif c in "?*+@!" and t[i + 1 : i + 2] == "(":
                i = self._paren(t, i + 1)
            elif c in self._META:
                break
            else:
                i += 1
        return i

    def _array(self, t: str, i: int) -> int:
        """i is at the parenthesis of an array literal, which holds words, line ends and remarks only."""
        i += 1
        while i < len(t):
            if t[i] == ")":
                return i + 1
            if t[i] in " \t\n":
                i += 1
            elif t.startswith("\\\n", i):
                i += 2
            elif t[i] == "#":
                j = t.find("\n", i)
                i = len(t) if j < 0 else j
            else:
                j = self._word(t, i)
                if j == i:
                    raise Rejected
                i = j
        raise Rejected

    _BINARY = {"==", "=", "!=", "=~", "<", ">", "-eq", "-ne", "-lt", "-le", "-gt", "-ge", "-nt", "-ot", "-ef"}

    def _cond(self, t: str, i: int) -> int:
        """i is behind [[; the position after the ]] that ends the condition."""

        def blank(i: int, lines: bool = True) -> int:
            return re.compile(r"(?:[ \t\n]|\\\n)*" if lines else r"(?:[ \t]|\\\n)*").match(t, i).end()

        def word(i: int) -> int:
            j = self._word(t, i)
            if j == i or t[i:j] == "]]":
                raise Rejected
            return j

        def regex(i: int) -> int:
            j, depth = i, 0
            while j < len(t) and (depth or t[j] not in " \t\n"):
                c = t[j]
                if c == "\\":
                    j += 2
                elif c == "[" and (m := re.compile(r"\[\^?\]?(?:\[:\w+:\]|[^\]\s$\"'])*\]").match(t, j)):
                    j = m.end()
                elif c in "'\"$`":
                    j = {"'": self._single, '"': self._double, "$": self._dollar, "`": self._back}[c](t, j)
                else:
                    depth += {"(": 1, ")": -1}.get(c, 0)
                    if depth < 0:
                        break
                    j += 1
            if j == i or depth > 0 or t[i:j] == "]]":
                raise Rejected
            return j

        def term(i: int) -> int:
            i = blank(i)
            if t.startswith("(", i):
                i = blank(either(i + 1))
                if t[i : i + 1] != ")":
                    raise Rejected
                return i + 1
            j = word(i)
            w = t[i:j]
            if w == "!":
                return term(j)
            if re.fullmatch(r"-[a-hknoprstuvwxzGLNORS]", w):
                return word(blank(j, False))
            k = blank(j, False)
            op = t[k] if t[k : k + 1] in ("<", ">") else t[k : self._word(t, k)]
            if op not in self._BINARY:
                return j
            k = blank(k + len(op), False)
            return regex(k) if op == "=~" else word(k)

        def either(i: int) -> int:
            i = term(i)
            while t.startswith(("&&", "||"), blank(i)):
                i = term(blank(i) + 2)
            return i

        i = blank(i)
        if not t.startswith("]]", i):  # bash takes an empty condition
            i = blank(either(i))
        if not re.compile(r"\]\](?=[\s;&|)<>]|\Z)").match(t, i):
            raise Rejected
        return i + 2

    def _lex(self, t: str) -> str:
        ch, br = self.g.char, self.g.brackets
        out: list[str] = []
        i, command, heredocs, cases, n = 0, True, [], [], len(t)
        while i < n:
            c = t[i]
            if c in " \t":
                i += 1
            elif c == "\\" and t[i + 1 : i + 2] == "\n":
                i += 2
            elif c == "#":
                j = t.find("\n", i)
                i = n if j < 0 else j
            elif c == "\n":
                out.append(ch[";;NL"])
                i, command = i + 1, True
                for tag, strip in heredocs:
                    while True:
                        j = t.find("\n", i)
                        line = t[i:] if j < 0 else t[i:j]
                        i = n if j < 0 else j + 1
                        if (line.lstrip("\t") if strip else line) == tag or j < 0:
                            break
                heredocs = []
            elif cases and cases[-1] == "pat" and not re.match(r"esac\b", t[i:]):
                j = i + (c == "(")
                while j < n and t[j] != ")":
                    if t[j] in "\n;&<>":
                        raise Rejected
                    k = self._word(t, j)
                    j = k if k > j else j + 1
                if j >= n:
                    raise Rejected
                out.append(ch["CASEPAT"])
                cases[-1], i, command = "body", j + 1, True
            elif t.startswith(";;", i) or t.startswith(";&", i):
                three = t.startswith(";;&", i)
                out.append(ch[";;"] if t[i + 1] == ";" else ch[";&"])
                i, command = i + 2 + three, True
                if cases:
                    cases[-1] = "pat"
            elif c == ";" or c == "&" or c == "|":
                if t.startswith("&>", i):
                    out.append(ch["REDIR"])
                    i += 2 + t.startswith("&>>", i)
                    continue
                op = t[i : i + 2] if t[i : i + 2] in ("&&", "||", "|&") else c
                out.append(ch[op])
                i, command = i + len(op), True
            elif m := re.compile(r"\d*(?:<<-?|<<<|<>|>>|>\||[<>]&?)").match(t, i) if c in "<>0123456789" and not t.startswith(("<(", ">("), i) else None:
                op = m.group()
                if t.startswith("<<<", i + len(op) - len(op.lstrip("0123456789"))):
                    i = m.end() + (not op.endswith("<<<"))
                    out.append(ch["REDIR"])
                    continue
                i = m.end()
                if op.lstrip("0123456789") in ("<<", "<<-"):
                    i += len(re.match(r"[ \t]*", t[i:]).group())
                    j = self._word(t, i)
                    if j == i:
                        raise Rejected
                    heredocs.append((re.sub(r"[\\'\"]", "", t[i:j]), op.endswith("-")))
                    out.append(ch["REDIRFD"])
                    i = j
                elif op.endswith("&") and (k := re.match(r"\d+-?|-", t[i:])):
                    i += k.end()
                    out.append(ch["REDIRFD"])
                else:
                    out.append(ch["REDIR"])
            elif c == "(":
                if command and t.startswith("((", i):
                    j = self._paren(t, i)
                    if t[j - 2 : j] == "))":
                        out.append(ch["ARITH"])
                        i, command = j, False
                        continue
                if out and out[-1] == ch["for"] and t.startswith("((", i):
                    out.append(ch["ARITH"])
                    i = self._paren(t, i)
                    continue
                out.append(br["("])
                i, command = i + 1, True
            elif c == ")":
                out.append(br[")"])
                i, command = i + 1, True
            else:
                j = self._word(t, i)
                w = t[i:j]
                if j == i:
                    raise Rejected
                after = out[-1] if out else ""
                if w == "[[" and command:
                    k = self._cond(t, j)
                    out.append(ch["COND"])
                    i, command = k, False
                    continue
                name = re.match(r"[A-Za-z_]\w*(?:\[[^\]]*\])?\+?=", w)
                if command and (w in self.RESERVED or w in "{}") and w != "in":
                    out.append(ch[w] if w not in "{}" else br[w])
                    command = w not in ("case", "for", "select", "function", "fi", "done", "esac", "}")
                    if w == "case":
                        cases.append("word")
                    elif w == "esac" and cases:
                        cases.pop()
                elif w == "in" and (cases and cases[-1] == "word" or len(out) > 1 and out[-2] in (ch["for"], ch["select"])):
                    out.append(ch["in"])
                    if cases and cases[-1] == "word":
                        cases[-1] = "pat"
                    command = False
                elif name:
                    if t.startswith("(", j) and j - i == name.end():
                        k = self._array(t, j)
                        out.append(ch["ASSIGN"])
                        i = k
                        continue
                    out.append(ch["ASSIGN"] if command or after == ch["ASSIGN"] else ch["WORD"])
                else:
                    out.append(ch["WORD"])
                    command = False
                i = j
        return "".join(out)


_MAKERS = {
    "java": Java, "go": Go, "python": Python, "json": Json, "xml": Xml, "yaml": Yaml, "bash": Bash,
    "javascript": lambda: Ecma(False), "typescript": lambda: Ecma(True),
}


@functools.cache
def parser(lang: str):
    return _MAKERS[lang]()


def valid(lang: str, text: str) -> bool:
    """Whether any dialect of the language derives the text. A text of blanks only is valid but for XML and JSON."""
    return parser(lang).valid(text)
