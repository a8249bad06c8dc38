"""Problem 5: personal data in free text, by a character-level bidirectional LSTM with CRF transitions, and its placeholders."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from functools import lru_cache
from importlib import resources

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.tables import newest, spread

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
#: tags: 0 outside, 2k + 1 begin and 2k + 2 inside of kind k
TAGS = 1 + 2 * len(KINDS)
#: characters of a window and between the starts of two windows; what lies in two windows is reconciled
WINDOW, STRIDE = 192, 128
#: windows a matrix holds at once
AT_ONCE = 512
VOCABULARY = 128 + 6


def codes(text: str) -> np.ndarray:
    """A number below ``VOCABULARY`` for each character: ASCII as it is, others by their class."""
    u = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    wide = np.nonzero(u >= 128)[0]
    if len(wide):
        u = u.copy()
        for k in wide:
            c = chr(u[k])
            u[k] = 128 + (0 if c.isupper() else 1 if c.islower() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c in "º°ª" else 5)
    return u


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def scan(table: np.ndarray, inner: np.ndarray, x: np.ndarray, keep: bool = False):
    """Hidden states (T, B, H) of an LSTM over codes x (T, B): input weights are rows of ``table``; with ``keep`` also gates and cells."""
    steps, batch = x.shape
    size = inner.shape[0]
    h, c = np.zeros((batch, size), np.float32), np.zeros((batch, size), np.float32)
    out = np.empty((steps, batch, size), np.float32)
    gates = np.empty((steps, batch, 4 * size), np.float32) if keep else None
    cells = np.empty((steps, batch, size), np.float32) if keep else None
    for t in range(steps):
        g = table[x[t]] + h @ inner
        s = sigmoid(g[:, : 3 * size])
        n = np.tanh(g[:, 3 * size :])
        c = s[:, size : 2 * size] * c + s[:, :size] * n
        h = s[:, 2 * size :] * np.tanh(c)
        out[t] = h
        if keep:
            gates[t, :, : 3 * size], gates[t, :, 3 * size :], cells[t] = s, n, c
    return (out, gates, cells) if keep else out


class Tagger:
    """The trained model: tables of input weights and inner weights of both directions, output weights, transitions."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: v.astype(np.float32) for k, v in weights.items()}

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores (T, B, TAGS) of codes (T, B)."""
        w = self.w
        a = scan(w["table_f"], w["inner_f"], x)
        b = scan(w["table_b"], w["inner_b"], x[::-1])[::-1]
        return np.concatenate([a, b], axis=2) @ w["out"] + w["bias"]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tags (T, B) by Viterbi over emissions and transitions."""
        e, trans = self.emissions(x), self.w["trans"]
        score = e[0] + self.w["start"]
        back = np.empty(e.shape, np.int8)
        for t in range(1, len(e)):
            s = score[:, :, None] + trans[None]
            back[t] = s.argmax(axis=1)
            score = np.take_along_axis(s, back[t][:, None, :].astype(np.int64), axis=1)[:, 0] + e[t]
        tags = np.empty(e.shape[:2], np.int8)
        tags[-1] = score.argmax(axis=1)
        for t in range(len(e) - 1, 0, -1):
            tags[t - 1] = np.take_along_axis(back[t], tags[t][:, None].astype(np.int64), axis=1)[:, 0]
        return tags

    def spans(self, texts: list[str], check: bool = True) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of each text, apart and in order. Every text is read whole, by windows that overlap."""
        at: list[tuple[int, int]] = []
        rows: list[np.ndarray] = []
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]

        def flush() -> None:
            order = sorted(range(len(rows)), key=lambda k: len(rows[k]))
            for a in range(0, len(order), AT_ONCE):
                part = order[a : a + AT_ONCE]
                steps = max(len(rows[k]) for k in part)
                x = np.full((steps, len(part)), 10, np.int64)
                for j, k in enumerate(part):
                    x[: len(rows[k]), j] = rows[k]
                tags = self.decode(x)
                for j in np.nonzero(tags.any(axis=0))[0]:
                    k = part[j]
                    t, start = at[k]
                    found[t] += [(start + p, start + q, kind) for p, q, kind in runs(tags[: len(rows[k]), j])]
            at.clear()
            rows.clear()

        for t, text in enumerate(texts):
            c = codes(text)
            for start in range(0, max(1, len(c) - (WINDOW - STRIDE)), STRIDE):
                at.append((t, start))
                rows.append(c[start : start + WINDOW])
            if len(rows) >= 8 * AT_ONCE:
                flush()
        flush()
        return [reconciled(text, f, check) for text, f in zip(texts, found)]


def runs(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the spans of one window's tags."""
    out, t, n = [], 0, len(tags)
    while t < n:
        g = int(tags[t])
        if g == 0:
            t += 1
            continue
        kind, start = (g - 1) // 2, t
        t += 1
        while t < n and tags[t] == 2 * kind + 2:
            t += 1
        out.append((start, t, kind))
    return out


# ---- exact checks of a span ------------------------------------------------------------------------------------
_AT = re.compile(r"@|＠|[\[({<]\s*at\s*[\])}>]|\s(?:at|AT|At)\s")
_TITLE = re.compile(r"(?i)^(?:mr|mrs|ms|mx|miss|dr|prof|professor|sir|herr|frau|mme|mlle|señora?|sra?|don|doña)\.?\s+[^\W\d_]{2,}")
_BEYOND = re.compile(r"\n|\b((?!(?:mrs|prof)\b)[^\W\d_]{3,})\.\s", re.I)
_NUMBER = re.compile(r"\d")


def plausible(kind: str, value: str) -> bool:
    """Whether a span can be what its tags say: an address has an at-sign in some spelling and a dot behind it, a number digits, a name two words."""
    digits = len(_NUMBER.findall(value))
    if kind == "email":
        m = _AT.search(value)
        return bool(m) and m.start() > 0 and bool(re.search(r"\w\s*(?:\.|[\[({<]?\s*dot\s*[\])}>]?)\s*[A-Za-z]{2,}", value[m.end() :], re.I))
    if kind == "phone":
        return 7 <= digits <= 18
    if kind == "id_number":
        return digits >= 5 and not re.match(r"\d{4}-\d\d?(?:-|$)", value)
    if kind == "street_address":
        return digits >= 1 and sum(c.isalpha() for c in value) >= 4 and not re.search(r"[_=:{}]", value)
    words = re.findall(r"[^\W\d_]+", value)
    if digits or re.search(r"[_=:/{}()\[\]@]|\.[^\s]", value):
        return False
    return len(words) >= 2 and max(map(len, words)) >= 3 and not re.fullmatch(r"[a-z]+(?:-[a-z]+)+", value) or bool(_TITLE.match(value))


def reconciled(text: str, found: list[tuple[int, int, int]], check: bool = True) -> list[tuple[int, int, str]]:
    """Spans of all windows of a text made one: of those that meet and have one kind the union, of others the longer.

    A span that begins or ends inside a word takes the word; a number of which two characters or more were left out is
    none. Blanks and quotes at the ends are left out. With ``check``, what cannot be is dropped.
    """
    out: list[list[int]] = []
    for a, b, kind in sorted(found):
        if out and a < out[-1][1]:
            last = out[-1]
            if kind == last[2]:
                last[1] = max(b, last[1])
            elif b - a > last[1] - last[0]:
                out[-1] = [a, b, kind]
            continue
        out.append([a, b, kind])
    clean, last = [], 0
    for a, b, kind in out:
        x, y = a, b
        if text[a:b].strip():
            while x > last and text[x].isalnum() and (text[x - 1].isalnum() or kind in (1, 2) and text[x - 1] in "-." and x > 1 and text[x - 2].isalnum()):
                x -= 1
            while y < len(text) and text[y - 1].isalnum() and text[y].isalnum():
                y += 1
        value = text[x:y]
        if kind == 4 and (m := _BEYOND.search(value)):  # a name ends with its sentence or line
            y = x + m.start() + len(m[1] or "")
            value = text[x:y]
        x, y = x + len(value) - len(value.lstrip(" \t\r\n\"'<=:")), y - (len(value) - len(value.rstrip(" \t\r\n\"'>,;:" + "." * (kind == 4))))
        if y > x and (not check or plausible(KINDS[kind], text[x:y]) and not (kind in (1, 2) and (a - x > 1 or y - b > 1))):
            clean.append((x, y, KINDS[kind]))
            last = y
    return clean


def placeholders(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with ``[EMAIL]`` and the like in place of the spans; the rest unchanged."""
    out, last = [], 0
    for a, b, kind in spans:
        out += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join([*out, text[last:]])


@lru_cache(maxsize=1)
def tagger() -> Tagger:
    """The model that ``pii_train`` wrote."""
    raw = resources.files("corpusloom.llm").joinpath("pii_weights.npz").read_bytes()
    return Tagger(dict(np.load(io.BytesIO(raw))))


# ---- plan -----------------------------------------------------------------------------------------------------
FOUND = "tab string, row_id string, field_name string, kinds array<string>, masked string"


def personal_data(incidents: DataFrame, interactions: DataFrame, with_text: bool = False) -> DataFrame:
    """(tab, row_id, field_name, kinds, masked) of every field that holds personal data.

    Fields are incidents.logs, incidents.description and interactions.question, each read whole. Of repeated ids the
    latest delivery counts (received_at, logged_at). Null ids, null and empty texts give no rows; empty tables none; extra
    columns are ignored. ``masked`` (with ``with_text``) is the text with typed placeholders. Texts are tagged where they
    lie; nothing is shuffled but ids, and the rows of ids that repeat.
    """
    a = newest(incidents, "id", "received_at", ["logs", "description"])
    b = newest(interactions, "id", "logged_at", ["question"])
    fields = a.select(F.lit("incidents").alias("tab"), F.col("id").alias("row_id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in ("logs", "description")])).alias("f"))
    fields = fields.select("tab", "row_id", "f.field_name", "f.text").unionByName(b.select(F.lit("interactions").alias("tab"), F.col("id").alias("row_id"), F.lit("question").alias("field_name"), F.col("question").alias("text")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = tagger()
        for batch in batches:
            spans = model.spans(batch["text"].tolist())
            batch["kinds"] = [sorted({k for _, _, k in s}) for s in spans]
            batch["masked"] = [placeholders(t, s) if s and with_text else None for t, s in zip(batch["text"], spans)]
            hit = batch[[bool(s) for s in spans]]
            yield hit[["tab", "row_id", "field_name", "kinds", "masked"]]

    return spread(fields.where("text IS NOT NULL AND text <> ''")).mapInPandas(run, FOUND)
