"""Problem 4: texts over a size limit in pieces under it, cut at natural boundaries, with an overlap."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_LIMIT, FILE_LIMIT, OVERLAP = 4096, 16384, 200
_SENTENCE = re.compile(r"(?<=[.!?;,}\])])\s+|(?<=[;{}])|(?<=[。！？])|(?<=\s)(?=\S)")
_OPENS = re.compile(r"^\s*(?:#{1,6} |(?:public|private|protected|static|final|abstract|export|async|def|class|func|function|interface|enum|type|struct|@\w)\b|[A-Za-z_-]+:\s*$|<\w)")


def atoms(text: str, most: int) -> list[str]:
    """The text in segments of at most ``most`` bytes, whose concatenation is the text: lines; of longer lines sentences or words; of longer words runs of characters."""
    out: list[str] = []
    for line in text.splitlines(keepends=True) if "\r" in text and "\n" not in text else re.split(r"(?<=\n)", text):
        if not line:
            continue
        if len(line) <= most and len(line.encode()) <= most:
            out.append(line)
            continue
        at = 0
        for m in [*_SENTENCE.finditer(line), None]:
            end = m.end() if m else len(line)
            if end == at:
                continue
            part, at = line[at:end], end
            if len(part) <= most and len(part.encode()) <= most:
                out.append(part)
                continue
            have, start = 0, 0
            for k, c in enumerate(part):  # no boundary in it: by characters, never inside one
                b = len(c.encode())
                if have + b > most:
                    out.append(part[start:k])
                    have, start = 0, k
                have += b
            out.append(part[start:])
    return out


def strength(before: str, after: str) -> int:
    """How natural a cut between two neighbouring segments is: higher between sections than inside a sentence."""
    if not before.endswith(("\n", "\r")):
        return 2 if before.rstrip().endswith((".", "!", "?", "。", ";", "}")) else 1 if before.endswith((" ", "\t")) else 0
    blank, nxt = not before.strip(), after.strip()
    if not nxt:
        return 4  # a blank line stays with what stands before it
    indent = len(after) - len(after.lstrip())
    level = 12 - min(indent, 8)
    if blank:
        level += 8
    elif before.rstrip() in ("}", "};", "```", "---", "end"):
        level += 4
    if _OPENS.match(after):
        level += 3
    if nxt[0] in ")}]":
        level -= 9
    return max(level, 3)


def merged(segments: list[str], most: int) -> list[str]:
    """Agglomerative merging: of all neighbouring pairs in a heap the weakest boundary is merged first, the smaller pair of equals, as long as both fit in ``most`` bytes."""
    n = len(segments)
    size = [len(s.encode()) for s in segments]
    weight = [strength(segments[k], segments[k + 1]) for k in range(n - 1)]
    end = list(range(1, n + 1))  # of the run that begins at k
    start = list(range(n))  # of the run whose last segment is k
    heap = [(weight[k], size[k] + size[k + 1], k + 1) for k in range(n - 1)]
    heapq.heapify(heap)
    alive = [True] * n  # boundary k lies between segments k - 1 and k
    while heap:
        w, total, k = heapq.heappop(heap)
        if not alive[k]:
            continue
        a = start[k - 1]
        now = size[a] + size[k]
        if now > most:
            continue  # runs only grow, so this boundary stays
        if now != total:
            heapq.heappush(heap, (w, now, k))
            continue
        alive[k] = False
        size[a], end[a] = now, end[k]
        start[end[k] - 1] = a
    cuts = [0] + [k for k in range(1, n) if alive[k]] + [n]
    return ["".join(segments[a:b]) for a, b in zip(cuts, cuts[1:])]


def _tail(text: str, overlap: int) -> str:
    """The longest end of at most ``overlap`` bytes that begins with a character."""
    return text.encode()[-overlap:].decode("utf-8", "ignore") if overlap else ""


def pieces(text: str, limit: int, overlap: int = OVERLAP, first_line: int = 1) -> list[tuple[str, int, int, int]]:
    """(piece, bytes of overlap at its head, start_line, end_line): pieces of at most ``limit`` bytes of UTF-8.

    Without their overlaps they are the text, byte by byte. Every piece but the first begins with the last ``overlap`` bytes
    of the text before it (fewer by at most 3 where these would begin inside a character). A text within the limit is one piece.
    """
    if overlap < 0 or limit < overlap + 4:
        raise ValueError("the limit must hold the overlap and one character")
    if len(text.encode()) <= limit:
        return [(text, 0, first_line, first_line + text[:-1].count("\n"))]
    out, done, line = [], "", first_line
    for body in merged(atoms(text, limit - overlap), limit - overlap):
        head = _tail(done, overlap)
        begins = line - head.count("\n")
        out.append((head + body, len(head.encode()), begins, line + body[:-1].count("\n")))
        line += body.count("\n")
        done = (done + body)[-overlap:] if overlap else ""
    return out


_COLUMNS = "item_kind string, item_id string, at long, piece_no int, start_line long, end_line long, n_bytes long, overlap long, piece string"


def _cut(limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for kind, id_, at, first, text in zip(b.item_kind, b.item_id, b["at"], b.first_line, b.text):
                got = pieces(text, limit, overlap, int(first))
                yield pd.DataFrame([(kind, id_, at, k, a, z, len(p.encode()), h, p) for k, (p, h, a, z) in enumerate(got)], columns=[c.split()[0] for c in _COLUMNS.split(", ")])

    return run


def _latest(rows: DataFrame) -> DataFrame:
    """(item_id, at) of the newest delivery of each item, with the size it has there."""
    return rows.groupBy("item_id").agg(F.max(F.struct("at", "n")).alias("r")).select("item_id", "r.at", "r.n")


def oversized(items: DataFrame, kind: str, key: str, order: str, text: str, line: str | None, limit: int, overlap: int = OVERLAP) -> DataFrame:
    """(item_kind, item_id, piece_no, start_line, end_line, n_bytes, overlap, piece) of the items over ``limit`` bytes.

    Sizes are measured on the text. Of repeated ids the latest delivery counts (null is oldest, of one time the longest text), once. Null ids and
    null or empty texts give none; a null first line counts as 1; empty tables give no rows; extra columns are ignored.
    Only oversized texts leave the JVM, and only they are read as a whole; all other rows bring an id, a time and a size.
    """
    at = F.coalesce(F.unix_micros(F.col(order).cast("timestamp")), F.lit(-(1 << 62)).cast("long"))
    first = F.coalesce(F.col(line), F.lit(1)) if line else F.lit(1)
    rows = items.where(F.col(key).isNotNull()).select(F.lit(kind).alias("item_kind"), F.col(key).cast("string").alias("item_id"), at.alias("at"), first.cast("long").alias("first_line"), F.col(text).alias("text"))
    last = _latest(rows.select("item_id", "at", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))).where(F.col("n") > limit)
    cut = rows.where(F.octet_length("text") > limit).mapInPandas(_cut(limit, overlap), _COLUMNS)
    # the same delivery twice has the same pieces; of different texts at one time the longest is kept
    return cut.join(last.select("item_id", "at"), ["item_id", "at"]).dropDuplicates(["item_id", "piece_no"]).select("item_kind", "item_id", "piece_no", "start_line", "end_line", "n_bytes", "overlap", "piece")


def all_pieces(chunks: DataFrame, files: DataFrame, chunk_limit: int = CHUNK_LIMIT, file_limit: int = FILE_LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every oversized chunk and file (see ``oversized``)."""
    return oversized(chunks, "chunk", "id", "ingested_at", "text", "start_line", chunk_limit, overlap).unionByName(
        oversized(files, "file", "file_id", "scanned_at", "content", None, file_limit, overlap)
    )


FOUND_SQL = """
SELECT 'chunk' AS item_kind, id AS item_id FROM chunks WHERE id IS NOT NULL GROUP BY id HAVING arg_max(strlen(text), coalesce(ingested_at, TIMESTAMP '0001-01-01')) > 4096
UNION ALL
SELECT 'file', CAST(file_id AS VARCHAR) FROM source_files WHERE file_id IS NOT NULL GROUP BY file_id HAVING arg_max(strlen(content), coalesce(scanned_at, TIMESTAMP '0001-01-01')) > 16384
"""
