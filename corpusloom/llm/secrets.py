"""Problem 3: credentials in source code, configuration and paths, and their redaction in the original bytes."""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values: names under which credentials are kept, and shapes of values ------------------------------
#: words of a name that say what the value is
_SECRET_WORDS = (
    "password passwd passwort kennwort pwd pw pass passphrase pgpassword secret token cred creds credential credentials auth login seed clave contrasena mdp motdepasse apikey authtoken bearer"
).split()
#: with "key" behind them they name a credential
_KEY_WORDS = "api access private encryption hmac signing secret account master shared license service auth".split()
#: words that turn a name into one of a label, an id or an address
_LABEL_WORDS = "label policy name param header hint prompt field path url uri sha etag id digest checksum hash length ttl expiry expires count size type endpoint public pub file prefix".split()
_TOKENS = re.compile(
    r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_\w{22,}|xox[abprs]-\d+-[\w-]+|[a-z]{2,4}_(?:live|test)_[A-Za-z0-9]{16,}|gl(?:t|pat)[.-][\w-]{16,}|AIza[\w-]{35}|SG\.[\w-]{16,}\.[\w-]{16,}"
    r"|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})"
)
_PARTS = re.compile(r"^(?:AKIA|ASIA|gh[pousr]_|xox[abprs]-|[a-z]{2,4}_live_|glt\.|glpat-|eyJ)")
_PLACEHOLDER = re.compile(
    r"(?i)^(?:[*x.\-_#?]+|todo|tbd|none|null|nil|true|false|undefined|(?:re|please.?)?place_?me|replace.*|change.?(?:me|it)|your\b.*|my.?(?:secret|password|token|key)|example.*|dummy.*|sample.*|redacted|string|secret|password|token"
    r"|\$[({]?.*|\{\{.*|<.*>|%\w+%|%\(.*|(?:vault|env|ssm|aws-sm|gcp-sm|kms|secretref|ref|file|keychain|op)[:/].*|arn:.*|@.*@|process\.env.*|os\.(?:environ|getenv).*|system\.getenv.*)$"
)
# --------------------------------------------------------------------------------------------------------------
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: key, mark of assignment, value with its quote; a type may stand between key and mark
_PAIR = re.compile(
    r"""(?P<q>["']?)(?P<key>[A-Za-z_][\w.\-]*)(?P=q)(?:[ \t]*:[ \t]*(?:string|String|str)(?=[ \t]*=))?[ \t]*(?P<op>:=|=>|[:=])[ \t]*(?:["'`]?(?P<list>[({\[])[ \t]*)?(?:(?P<dq>"(?:[^"\\\n]|\\.)*")|(?P<sq>'(?:[^'\\\n]|\\.)*')|(?P<bq>`[^`\n]*`)|(?P<bare>[^\s"'`,<][^\s"'`<]*))"""
)
_NEXT = re.compile(r"""[ \t]*(?:[+\\.]|\|\|)?[ \t]*\r?\n[ \t]*(?:[+.]|\|\|)?[ \t]*(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`)""")
_ELEMENT = re.compile(r"<(?P<key>[A-Za-z_][\w.\-]*)(?:\s[^<>]*)?>(?P<v>[^<>\n]+)</(?P=key)>")
_ATTRIBUTE = re.compile(r"""(?:name|key)=(["'])(?P<key>[\w.\-]+)\1\s+value=(["'])(?P<v>[^"'\n]+)\3""")
_USERINFO = re.compile(r"[A-Za-z][\w+.\-]*://[^/\s:@\"'<>]*:(?P<v>[^/\s@\"'<>]+)@")
_ARGUMENT = re.compile(r"(?<![\w])(?P<key>[A-Za-z][\w\-]*)=(?P<v>[^\s&;\"'<>=/]+)")
_HEADER = re.compile(r"(?i)\b(?P<key>bearer|basic)[ \t]+(?P<v>[A-Za-z0-9._~+/\-]{8,}=*)")
_COLON = re.compile(r"(?<![\w])(?P<key>[A-Za-z][\w\-]*):[ \t]+(?P<v>[^\s\"'`,;]+)")
_PROSE = re.compile(r"(?i)\b(?P<key>passwor[dt]|passwd|pwd|kennwort|clave|mot de passe|passphrase|secret|token|api key)[ \t]+(?:is[ \t]+|:[ \t]*)?(?P<v>[^\s\"'`,;]{6,})[ \t]*(?:\*/|-->)?[ \t]*$", re.M)
_SLASHED = re.compile(r"(?i)\b(?P<key>login|user|account|zugang|acceso)[ \t]+[\w.\-@]+[ \t]*/[ \t]*(?P<v>[^\s\"'`,;]{6,})[ \t]*(?:\*/|-->)?[ \t]*$", re.M)
_OPTION = re.compile(r"(?P<key>-u|--user)[ \t=]+[\"']?[\w.\-]+:(?P<v>[^\s\"'@]+)")
_BEGIN = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_END = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_ARMOUR = re.compile(r"^[\s\"'`+#*/|\\n]*[A-Za-z0-9+/=]{4,}[\s\"'`+,;\\n)]*$")
#: only lines with one of these (in lower case) can hold a credential
_HINTS = (
    "pass pwd pw kennwort secret token cred auth login seed clave contrase mdp mot\tde key bearer basic :// -u\t --user akia asia ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ xox _live_ _test_ glt. glt- glpat aiza sg. eyj private\tkey user\t acceso zugang"
).replace("\t", "_TAB_").split()
_HINTS = [w.replace("_TAB_", " ") for w in _HINTS]
_UNIT = re.compile(r"(?i)^(?:0x)?[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-|^sha\d*[:-]|^md5[:-]")
_WEAK = re.compile(r"^[a-z]+[._\-][a-z]+\d{1,4}$")


@lru_cache(maxsize=50_000)
def sensitivity(key: str) -> int:
    """2 if a name surely names a credential, 1 if only its last word does (a common noun there), 0 if it doesn't, -1 for a label, an id or an address."""
    words = [w.lower() for w in _WORD.findall(re.sub(r"-[0-9a-f]{4}$", "", key.rsplit(".", 1)[-1])) if not w.isdigit()]
    if not words:
        return 0

    def names(ws: list[str]) -> bool:
        return any(w in _SECRET_WORDS for w in ws) or any(b in ("key", "keys") and a in _KEY_WORDS for a, b in zip(ws, ws[1:])) or any(a in ("mot", "de") and b == "passe" for a, b in zip(ws, ws[1:]))

    if any(w in _LABEL_WORDS for w in words[:-1]):
        return -1
    if len(words) > 1 and not names(words[:-1]) and not any(w in ("password", "passwd", "pwd", "passwort") for w in words):
        return 1 if names(words) else 0
    return 2 if names(words) else 0


def literal(value: str, level: int) -> bool:
    """Whether a value is a literal credential: no placeholder, reference, label or word; of mixed characters. level as of ``sensitivity``."""
    v = value.strip()
    if len(v) < 6 or len(v) > 512 or any(c.isspace() for c in v) or _PLACEHOLDER.match(v) or "${" in v or "{{" in v or "://" in v:
        return False
    if _TOKENS.search(v) or _PARTS.match(v):
        return True
    if level < 1 or _UNIT.match(v):
        return False
    digits, letters = any(c.isdigit() for c in v), any(c.isalpha() for c in v)
    if not letters or v.startswith(("/", "./", "../")) or re.search(r"[()\[\]{}<>;]|::|->", v):
        return False
    if _WEAK.match(v):
        return level >= 2
    kinds = sum((any(c.islower() for c in v), any(c.isupper() for c in v), digits, any(not c.isalnum() for c in v)))
    if level == 1:
        return digits and kinds >= 3 and len(v) >= 8 and not re.fullmatch(r"[a-zA-Z]+[a-z]\d{0,5}|[\w]+(?:[.-][\w]+)+", v)
    return (digits and (kinds >= 2)) or kinds >= 3 and not re.fullmatch(r"[A-Za-z]+(?:[._-][A-Za-z]+)*", v)


def _basic(v: str) -> bool:
    try:
        return b":" in base64.b64decode(v + "=" * (-len(v) % 4), validate=True)
    except (binascii.Error, ValueError):
        return False


def entries(text: str, start: int, stop: int) -> Iterator[tuple[str, str, list[tuple[int, int]]]]:
    """(key, value, places) of everything on one line that assigns a value: properties, YAML, JSON, XML, constants, connection strings, headers, remarks.

    Places are offsets of the value's parts, quotes excluded; a literal joined from several lines has several.
    """
    for m in _PAIR.finditer(text, start, stop):
        kind = next(k for k in ("dq", "sq", "bq", "bare") if m[k] is not None)
        a, b = m.span(kind)
        if kind == "bare":
            v = m["bare"].rstrip(";,)]}")
            yield m["key"], v, [(a, a + len(v))]
            continue
        parts, v, end = [(a + 1, b - 1)], text[a + 1 : b - 1], b
        while n := _NEXT.match(text, end):
            g = next(k for k in (1, 2, 3) if n[k] is not None)
            parts.append(n.span(g))
            v += n[g]
            end = n.end()
        yield m["key"], v, parts
    for pattern in (_ELEMENT, _ATTRIBUTE, _ARGUMENT, _COLON, _PROSE, _SLASHED):
        for m in pattern.finditer(text, start, stop):
            yield m["key"], m["v"], [m.span("v")]


def key_path(text: str, at: int, key: str) -> str:
    """The key with the keys of the lines that enclose its line by indentation (YAML, pretty JSON), outermost first."""
    start = text.rfind("\n", 0, at) + 1
    line = text[start : text.find("\n", start) % (len(text) + 1)]
    depth, path = len(line) - len(line.lstrip(" ")), [key]
    while start > 0 and depth > 0:
        prev = text.rfind("\n", 0, start - 1) + 1
        m = re.match(r"( *)(?:- )?[\"']?([A-Za-z_][\w.\-]*)[\"']?[ \t]*:[ \t]*[{\[]?[ \t]*$", text[prev : start - 1])
        if m and len(m[1]) < depth:
            path.append(m[2])
            depth = len(m[1])
        start = prev
    return ".".join(reversed(path))


#: places where a bare value (no quotes) is a literal, by content type
_BARE = {"spring_yaml", "docs", "bash", "maven", "openapi", "flyway", None, ""}


def spans(text: str, content_type: str | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the credentials of a text, in order and apart; offsets count characters."""
    found: list[tuple[int, int, str]] = []
    bare_ok, armoured = content_type in _BARE, False
    for start, stop in sorted(_hinted(text)):
        armoured = armoured or "PRIVATE KEY" in text[start:stop]
        found += _line(text, start, stop, bare_ok)
    if armoured:
        found += _armoured(text)
    found.sort()
    out: list[tuple[int, int, str]] = []
    for a, b, k in found:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), out[-1][2])
        elif b > a:
            out.append((a, b, k))
    return out


def _hinted(text: str) -> set[tuple[int, int]]:
    """(start, end) of the lines that hold one of ``_HINTS``; the words are sought one by one, which is far faster than one pattern."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    lines = set()
    for w in _HINTS:
        at = low.find(w)
        while at >= 0:
            stop = low.find("\n", at)
            stop = len(low) if stop < 0 else stop
            lines.add((low.rfind("\n", 0, at) + 1, stop))
            at = low.find(w, stop)
    return lines


def _line(text: str, start: int, stop: int, bare_ok: bool) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "token") for m in _TOKENS.finditer(text, start, stop)]
    for key, v, parts in entries(text, start, stop):
        level = 2 if key.lower() in ("mot de passe", "zugang", "acceso", "user", "account", "login") else sensitivity(key_path(text, parts[0][0], key) if bare_ok else key)
        a, b = parts[0]
        quoted = a > 0 and text[a - 1] in "\"'`" or text[b : b + 1] == "<"
        if level < 1 and not (quoted and len(parts) > 1 and _TOKENS.search(v)) or not literal(v, level):
            continue
        if not quoted:
            # in code a bare value is an expression; only inside a string or a remark it is a literal
            before = text[start:a]
            if not bare_ok and not re.search(r"//|#|^\s*\*|/\*|--\s|<!--", before) and before.count('"') % 2 == 0 and before.count("'") % 2 == 0 and before.count("`") % 2 == 0:
                continue
            if re.fullmatch(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*", v) and not (_WEAK.match(v) or _PARTS.match(v) or re.search(r"\d[A-Z]|[a-z][A-Z].*\d{2}|\d[a-z]", v)):
                continue
        if re.fullmatch(r"[0-9a-f]{32,}", v) and _WORD.findall(key)[-1:] and _WORD.findall(key)[-1].lower() in _LABEL_WORDS and sensitivity(key) < 2:
            continue
        found += [(x, y, "value") for x, y in parts]
    for m in _USERINFO.finditer(text, start, stop):
        if not _PLACEHOLDER.match(m["v"]) and not m["v"].startswith(("$", "{", "<", "%", "*")):
            found.append((*m.span("v"), "userinfo"))
    for m in _OPTION.finditer(text, start, stop):
        if literal(m["v"], 2):
            found.append((*m.span("v"), "option"))
    for m in _HEADER.finditer(text, start, stop):
        v = m["v"]
        if _basic(v) if m["key"].lower() == "basic" else literal(v, 2) and any(c.isdigit() for c in v):
            found.append((*m.span("v"), "header"))
    return found


def _armoured(text: str) -> list[tuple[int, int, str]]:
    """Private-key blocks, markers included; a block whose begin or end lies outside the text goes as far as its lines of key data do."""
    found, done = [], 0
    for m in _BEGIN.finditer(text):
        if m.start() < done:
            continue
        e = _END.search(text, m.end())
        other = _BEGIN.search(text, m.end())
        if e and not (other and other.start() < e.start()):
            end = e.end()
        else:
            end, at = m.end(), text.find("\n", m.end())
            while at >= 0:
                nl = text.find("\n", at + 1)
                line = text[at + 1 : nl if nl >= 0 else len(text)]
                if not _ARMOUR.match(line):
                    break
                end, at = at + 1 + len(line), nl
        found.append((m.start(), end, "private_key"))
        done = end
    for e in _END.finditer(text):
        if any(a <= e.start() < b for a, b, _ in found):
            continue
        start = line = text.rfind("\n", 0, e.start()) + 1
        while line > 0:
            prev = text.rfind("\n", 0, line - 1) + 1
            if not _ARMOUR.match(text[prev : line - 1]):
                break
            start = line = prev
        found.append((start, e.end(), "private_key"))
    return found


_PATH_PAIR = re.compile(r"(?<![A-Za-z0-9])(?P<key>[A-Za-z_]+)=(?P<v>[^/&;=]+)")
_PATH_INFO = re.compile(r"(?<![A-Za-z0-9])https?_[A-Za-z]+_(?P<v>[A-Za-z0-9]{10,})@|://[^/:@]*:(?P<w>[^/@]+)@|[^/:@]+:(?P<x>[^/@]{6,})@")


def path_spans(path: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the credentials of a path: tokens, arguments with sensitive names, and user data before a host."""
    found = [(m.start(), m.end(), "token") for m in re.finditer(_TOKENS.pattern.replace("(?<![A-Za-z0-9_])", "(?<![A-Za-z0-9])"), path)]
    found += [(*m.span("v"), "value") for m in _PATH_PAIR.finditer(path) if sensitivity(m["key"]) > 0 and literal(m["v"], 2)]
    for m in _PATH_INFO.finditer(path):
        g = next(k for k in ("v", "w", "x") if m[k])
        if literal(m[g], 2):
            found.append((*m.span(g), "userinfo"))
    return sorted(set(found))


def redact(text: str, places: list[tuple[int, int, str]], mark: str = "[REDACTED:{}]") -> str:
    """The text with each place replaced; every byte outside the places stays as it is, line ends and line counts included.

    Works on the UTF-8 bytes: the places are turned into byte offsets once, and the pieces between them are spliced.
    """
    raw = text.encode("utf-8")
    wide = len(raw) != len(text)
    out, last, char, byte = [], 0, 0, 0
    for a, b, kind in places:
        if wide:
            x = byte + len(text[char:a].encode("utf-8"))
            y = x + len(text[a:b].encode("utf-8"))
            char, byte = b, y
        else:
            x, y = a, b
        out += [raw[last:x], mark.format(kind).encode() + b"\n" * text.count("\n", a, b)]
        last = y
    return b"".join([*out, raw[last:]]).decode("utf-8")


def lines_of(text: str, places: list[tuple[int, int, str]]) -> list[int]:
    """Numbers, from 1, of the lines that the places touch."""
    out, line, at = [], 1, 0
    for a, b, _ in places:
        line += text.count("\n", at, a)
        last = line + text.count("\n", a, b)
        out += range(line, last + 1)
        line, at = last, b
    return sorted(set(out))


def _scan(batches: Iterator[pd.DataFrame], with_text: bool) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for id_, at, ct, text in zip(b.id, b["at"], b.content_type, b.text):
            p = spans(text, ct) if text else []
            rows.append((id_, at, lines_of(text, p) if p else [], redact(text, p) if p and with_text else None))
        yield pd.DataFrame(rows, columns=["id", "at", "lines", "redacted"])


def _scan_paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for id_, at, path in zip(b.id, b["at"], b.text):
            p = path_spans(path) if path else []
            rows.append((id_, at, bool(p), redact(path, p) if p else None))
        yield pd.DataFrame(rows, columns=["id", "at", "hit", "redacted"])


def credentials(chunks: DataFrame, files: DataFrame, with_text: bool = False) -> DataFrame:
    """(field_name, item_id, lines array<long>, redacted): every chunk text and file path that holds a credential.

    Each id counts once, by its latest delivery (greatest ingested_at or scanned_at; nulls are oldest, ties fall to the
    greater row). Null ids, null and empty texts give no rows; empty tables none; extra columns are ignored. Texts are
    scanned where they lie; only ids, line numbers and (``with_text``) redacted texts are shuffled. Numbers of lines
    count in the text split at line feeds.
    """
    old = F.lit(-(1 << 62)).cast("long")  # times go to Python as numbers, as a null time has no place among its dates
    t = chunks.where("id IS NOT NULL").select(F.col("id"), F.coalesce(F.unix_micros(F.col("ingested_at").cast("timestamp")), old).alias("at"), "content_type", "text")
    t = t.mapInPandas(lambda it: _scan(it, with_text), "id string, at long, lines array<long>, redacted string")
    t = t.groupBy("id").agg(F.max(F.struct("at", "lines", "redacted")).alias("r")).where("size(r.lines) > 0")
    p = files.where("file_id IS NOT NULL").select(F.col("file_id").cast("string").alias("id"), F.coalesce(F.unix_micros(F.col("scanned_at").cast("timestamp")), old).alias("at"), F.col("rel_path").alias("text"))
    # most paths have no character run that could be a credential; the rest go to Python
    p = p.mapInPandas(_scan_paths, "id string, at long, hit boolean, redacted string")
    p = p.groupBy("id").agg(F.max(F.struct("at", "hit", "redacted")).alias("r")).where("r.hit")
    return t.select(F.lit("text").alias("field_name"), F.col("id").alias("item_id"), F.col("r.lines").alias("lines"), F.col("r.redacted").alias("redacted")).unionByName(
        p.select(F.lit("rel_path").alias("field_name"), F.col("id").alias("item_id"), F.array(F.lit(0).cast("long")).alias("lines"), F.col("r.redacted").alias("redacted"))
    )
