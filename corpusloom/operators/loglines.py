"""Problem 6: log lines of several programs into entries with time, level, component and message."""

from __future__ import annotations

import datetime as dt
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.tables import newest, spread

# ---- fixed values: words of levels, months and keys ------------------------------------------------------------
LEVELS = {
    "trace": "TRACE", "debug": "DEBUG", "info": "INFO", "notice": "INFO", "warn": "WARN", "warning": "WARN", "error": "ERROR", "err": "ERROR", "fatal": "FATAL", "critical": "FATAL", "crit": "FATAL", "emerg": "FATAL", "panic": "FATAL",
}
INITIALS = {x[0]: x for x in ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")}
MONTHS = {m: k + 1 for k, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())}
_TIME_KEYS = {"ts", "time", "timestamp", "date", "at"}
_NAME_KEYS = {"logger", "component", "module", "unit", "source", "program", "service", "class"}
# -----------------------------------------------------------------------------------------------------------------
#: tokens at the head of a line that are mined and that a head may have
HEAD = 30
#: share of all lines that a pair of position and token, or a template, must have to be frequent
SHARE = 0.0005
_TOKEN = re.compile(r"[\w.\-$@]+|[^\w\s]")
_CLOCK = r"(\d\d):(\d\d):(\d\d)(?:[.,](\d{1,9}))?"
_TIMES = (
    ("iso", re.compile(r"(\d{4})[-/](\d\d)[-/](\d\d)[T ]" + _CLOCK + r"(?:\s?(Z|[+-]\d\d:?\d\d)(?!\w))?")),
    ("day", re.compile(r"(\d\d)/([A-Z][a-z]{2})/(\d{4}):" + _CLOCK + r"(?:\s?(Z|[+-]\d\d:?\d\d))?")),
    ("initial", re.compile(r"([TDIWEF])(\d\d)(\d\d) +" + _CLOCK)),
    ("month", re.compile(r"([A-Z][a-z]{2}) {1,2}(\d{1,2}) " + _CLOCK)),
    ("epoch", re.compile(r"(\d{13}|\d{10}(?:\.\d+)?)(?=[|,;\t ])")),
)
_ZERO = dt.datetime(1970, 1, 1)


def clock(line: str, at: int, year: int | None) -> tuple[int, int | None, str | None] | None:
    """(end, ms since 1970 in UTC, level of a leading initial) of the point in time that stands at a place of a line, else None."""
    for kind, pattern in _TIMES:
        m = pattern.match(line, at)
        if not m:
            continue
        g, level = m.groups(), None
        try:
            if kind == "epoch":
                return m.end(), int(g[0]) if len(g[0]) == 13 else int(float(g[0]) * 1000), None
            if kind == "iso":
                y, mo, d, rest = int(g[0]), int(g[1]), int(g[2]), g[3:]
            elif kind == "day":
                y, mo, d, rest = int(g[2]), MONTHS[g[1]], int(g[0]), g[3:]
            elif kind == "initial":
                y, mo, d, rest, level = year, int(g[1]), int(g[2]), g[3:], INITIALS[g[0]]
            else:
                y, mo, d, rest = year, MONTHS[g[0]], int(g[1]), g[2:]
            when = dt.datetime(y if y else 1972, mo, d, int(rest[0]), int(rest[1]), int(rest[2]))
        except (ValueError, KeyError):
            continue
        ms = (when - _ZERO) // dt.timedelta(milliseconds=1) + int(((rest[3] or "") + "000")[:3])
        zone = rest[4] if len(rest) > 4 else None
        if zone and zone != "Z":
            z = zone.replace(":", "")
            ms -= (1 if z[0] == "+" else -1) * (int(z[1:3]) * 60 + int(z[3:5])) * 60_000
        return m.end(), ms if y else None, level
    return None


def classes(line: str) -> list[tuple[int, int, str]]:
    """(start, end, class) of the first ``HEAD`` tokens: '#' for numbers and times, LEVEL, MON, '*' for words with digits, else the token itself."""
    out = []
    for m in _TOKEN.finditer(line):
        w = m.group()
        if w.lower() in LEVELS:
            c = "LEVEL"
        elif w in MONTHS:
            c = "MON"
        elif w[0].isdigit() or w[0] in "+-" and w[1:].isdigit():
            c = "#"
        elif w[0] in INITIALS and len(w) == 1:
            c = "INITIAL"
        elif any(x.isdigit() for x in w):
            c = "L#" if w[0] in INITIALS and w[1:].isdigit() else "*"
        else:
            c = w
        out.append((m.start(), m.end(), c))
        if len(out) == HEAD:
            break
    return out


def template(line_classes: list[tuple[int, int, str]], frequent: set[tuple[int, str]]) -> tuple[str, ...]:
    """The line with its frequent tokens as constants and the others as '*'."""
    return tuple(c if (k, c) in frequent else "*" for k, (_, _, c) in enumerate(line_classes))


def slots(t: tuple[str, ...]) -> tuple[int, int, int] | None:
    """(token of the time, of the level, of the component) by the constants of a template; -1 for a level in the time, or no component. None: no head of a record."""
    time = next((k for k, c in enumerate(t[:8]) if c in ("#", "L#", "MON")), None)
    if time is None or any(c[0].isalnum() and c.lower() not in _TIME_KEYS for c in t[:time]) or "*" in t[:time]:
        return None
    level = -1 if t[time] == "L#" else next((k for k in range(time + 1, len(t)) if t[k] == "LEVEL" or t[k] == "INITIAL" and t[k - 1] == "|"), None)
    if level is None:
        return None
    word = [k for k in range(time + 1, len(t)) if k != level and (t[k] == "*" or t[k][0].isalpha() and t[k] not in ("MON", "INITIAL", "LEVEL", "L#") and t[k].lower() not in _NAME_KEYS)]

    def sign(k: int) -> str:
        return t[k] if 0 <= k < len(t) else ""

    for k in range(time + 1, len(t)):  # by a key
        if t[k].lower() in _NAME_KEYS and sign(k + 1) in ("=", '"', "'", ":"):
            return time, level, next((j for j in word if j > k), -1)
    for k in word:  # file:line]
        if level == -1 and sign(k + 1) == ":" and sign(k + 2) == "#" and sign(k + 3) == "]":
            return time, level, k
    for k in word:  # program[process]: before the level
        if k < level and sign(k + 1) == "[" and sign(k + 2) == "#" and sign(k + 3) == "]":
            return time, level, k
    if "---" in t[level:]:  # level, process, [thread], name :
        return time, level, next((k for k in word if k > level and sign(k + 1) == ":"), -1)
    for k in word:
        near = sign(k - 1) + sign(k + 1)
        if near in ("--", "||") or near == "[]" and k == level + 3:
            return time, level, k
    return time, level, -1


def parse(line: str, year: int | None, frequent: set[tuple[int, str]], heads: dict[tuple[str, ...], tuple[int, int, int] | None]) -> tuple[int | None, str, str, int] | None:
    """(ms, level, component, where the message begins) of a line that opens a record, else None.

    The line's template says where its fields are; a line with a template that is not frequent is read by its own tokens.
    """
    if not line or line[0].isspace():
        return None
    cs = classes(line)
    t = template(cs, frequent)
    s = heads.get(t, 0)
    if s == 0:
        s = slots(tuple(c for _, _, c in cs))
    if s is None:
        return None
    time, level, name = s
    c = clock(line, cs[time][0], year)
    if c is None:
        return None
    end, ms, word = c
    if level >= 0:
        a, b, _ = cs[level]
        if a < end:
            return None
        w = line[a:b]
        word = LEVELS.get(w.lower()) or INITIALS.get(w)
        end = max(end, b)
    if word is None:
        return None
    component = ""
    if name >= 0:
        a, b, _ = cs[name]
        if a < c[0]:
            return None
        component, end = line[a:b], max(end, b)
    m = re.compile(r"[\]:)|\"',;#>]*(?:\d+\]|\[\d+\]:?)?[\s\-|:,]*(?:\"?(?:msg|message)\"?[=:]\s*\"?)?").match(line, end)
    return ms, word, component, m.end()


# ---- plan -----------------------------------------------------------------------------------------------------
def _texts(incidents: DataFrame, fields: list[str]) -> DataFrame:
    one = newest(incidents, "id", "received_at", ["created_at", *fields])
    parts = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])).alias("p")
    return spread(one.select("id", F.year("created_at").alias("year"), parts).select("id", "year", "p.field_name", "p.text").where("text IS NOT NULL AND text <> ''"))


def _count_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n: Counter = Counter()
    for b in batches:
        for text in b["text"]:
            for line in text.split("\n"):
                if line and not line[0].isspace():
                    n[-1, ""] += 1
                    n.update((k, c) for k, (_, _, c) in enumerate(classes(line)))
        if len(n) > 200_000:  # what has been counted goes on to the shuffle, all of it
            yield pd.DataFrame([(k, c, v) for (k, c), v in n.items()], columns=["pos", "token", "n"])
            n.clear()
    yield pd.DataFrame([(k, c, v) for (k, c), v in n.items()], columns=["pos", "token", "n"])


def mine(texts: DataFrame, share: float = SHARE) -> tuple[set[tuple[int, str]], dict[tuple[str, ...], tuple[int, int, int] | None]]:
    """(frequent pairs of position and token, frequent templates with their slots) over all lines of ``texts``.

    Both counts are map-side combined. At most ``HEAD / share`` pairs and ``1 / share`` templates can be frequent, so what
    comes to the driver is bounded whatever the number of lines.
    """
    pairs = texts.select("text").mapInPandas(_count_pairs, "pos int, token string, n long").groupBy("pos", "token").agg(F.sum("n").alias("n"))
    pairs = pairs.persist()
    total = pairs.where("pos = -1").agg(F.sum("n")).first()[0] or 0
    least = max(2.0, share * total)
    frequent = {(r["pos"], r["token"]) for r in pairs.where((F.col("pos") >= 0) & (F.col("n") >= least)).collect()}
    pairs.unpersist()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for b in batches:
            for text in b["text"]:
                for line in text.split("\n"):
                    if line and not line[0].isspace():
                        n["\t".join(template(classes(line), frequent))] += 1
            if len(n) > 200_000:
                yield pd.DataFrame(list(n.items()), columns=["template", "n"])
                n.clear()
        yield pd.DataFrame(list(n.items()), columns=["template", "n"])

    rows = texts.select("text").mapInPandas(count, "template string, n long").groupBy("template").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()
    return frequent, {t: slots(t) for t in (tuple(r["template"].split("\t")) for r in rows)}


ENTRY = "incident_id string, field_name string, line_no long, n_lines long, ts_ms long, log_level string, component string, message string"


def entries(incidents: DataFrame, fields: tuple[str, ...] = ("logs", "stack_trace"), share: float = SHARE) -> DataFrame:
    """One row for each log entry of the fields (columns as ``ENTRY``): where it begins, its lines, time, level, component and message.

    Frequent pairs of position and token are mined from all lines, templates are formed from them, and lines with rare
    templates are read by fallback rules on their own tokens. Lines before the first head of a text belong to no entry.
    Of repeated ids the latest ``received_at`` counts. Null ids, null and empty texts give no entries; without a year and
    with a null created_at, ts_ms is null. A carriage return at a line's end is no part of its message. Extra columns are
    ignored; empty tables give no rows. The message is the rest of the head line with the lines that follow it.
    """
    texts = _texts(incidents, list(fields))
    frequent, heads = mine(texts, share)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for id_, year, field, text in zip(b["id"], b["year"], b["field_name"], b["text"]):
                lines = text.split("\n")
                year = None if pd.isna(year) else int(year)
                found = [(k, p) for k, x in enumerate(lines) if (p := parse(x.rstrip("\r"), year, frequent, heads))]
                for (k, p), after in zip(found, [k for k, _ in found[1:]] + [len(lines)]):
                    ms, level, component, at = p
                    message = "\n".join([lines[k].rstrip("\r")[at:], *(x.rstrip("\r") for x in lines[k + 1 : after])])
                    rows.append((id_, field, k + 1, after - k, ms, level, component, message))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in ENTRY.split(", ")])
            out["ts_ms"] = out["ts_ms"].astype("Int64")
            yield out

    return texts.mapInPandas(run, ENTRY)
