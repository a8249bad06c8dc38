"""Problems 1 and 2: files that are not hand-written, and files that do not parse."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.alike import CELLS, _cell, _log, _table, parity_map
from corpusloom.sources.tables import cut

# ---- fixed values: notices by which tools and outside projects mark their files -----------------------------
_GENERATED = re.compile(
    r"(?i)^\W*(?:(?:\w+ )?code generated by\b.*do not (?:edit|modify)|@generated\b|auto-?generated file|this (?:file|code|class) (?:was|is|has been) (?:automatically|auto-?) ?generated"
    r"|<auto-?generated\b|generated source\b.*regenerate|machine (?:written|generated) by|generated by \S+.*(?:do not|don't) (?:edit|modify)"
    r"|diese datei wurde automatisch|automatisch (?:erzeugt|generiert)|este archivo (?:lo genera|fue generado|es generado)|(?:ce )?fichier (?:est )?(?:généré|genere)|ne pas modifier.*g[ée]n[ée]r|このファイルは.*(?:自動)?生成|自動生成)"
)
_OUTSIDE = re.compile(
    r"(?i)spdx-license-identifier:[^(]*\((?P<a>[\w-]+) (?:contributors|authors|project)\)|(?P<b>[\w-]+) v[\d.]+ \| \(c\) \d{4}|\(c\) \d{4}(?:-\d{4})? (?P<c>[\w-]+) (?:project|contributors)"
    r"|copyright (?:\(c\) )?\d{4}(?:-\d{4})?,? (?:the )?(?P<d>[\w-]+) (?:authors|project|contributors)|part of (?P<e>[\w-]+), release [\d.]+|granted to use (?P<f>[\w-]+) under|^\s*/\*!\s*(?P<g>[\w-]+) v[\d.]+"
)
_VENDOR_DIRS = {"third_party", "third-party", "thirdparty", "node_modules", "bower_components", "vendor", "vendored", "ext", "external", "extern", "deps"}
_SURE_DIRS = {"third_party", "third-party", "node_modules", "bower_components"}
#: folders of a layout, which name no project
_LAYOUT = {"src", "lib", "libs", "main", "java", "js", "python", "go", "dist", "include", "internal", "common"}
_ROOTS = re.compile(
    r"""^\s*package[ \t]+([\w.]+)|^\s*import[ \t]+(?:static[ \t]+)?((?:org|com|io|net|dev)\.[\w.]+)|^\s*(?:import|export)\b[^;'"]*?['"]((?!\.|node:)[@\w][^'"\n]*)['"]|\brequire\(['"]((?!\.|node:)[@\w][^'"\n]*)['"]\)""", re.M
)
_OWN = "northmere"
#: data and text formats, in which literals only is no sign of data saved as code
_DATA_NAMES = {"json", "yml", "yaml", "xml", "md", "txt", "csv", "sql", "properties", "toml", "html"}
_KEYWORDS = (
    "package import public private protected static final class interface enum extends implements return new if else for while do switch case break continue try catch finally throw throws void int long char boolean double float "
    "this super null true false func type struct map range defer go chan select const var let function async await export default from of in def lambda with as assert raise except elif not and or is None True False pass yield global "
    "string number typeof instanceof then fi done esac local echo exit"
).split()
# --------------------------------------------------------------------------------------------------------------
_TOKEN = re.compile(
    r"//[^\n]*|/\*.*?\*/|\"\"\".*?\"\"\"|'''.*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|\#[^\n]*|\b\d[\w.]*|[^\W\d][\w$]*|[^\s\w]", re.S
)
SHINGLE = 5
#: bits of a shape's parity map, by which pairs are left before their sets are compared; whole words of 64
BITS = 256
_ODD = np.uint64(0xD6E8FEB86659FD93)
_POLY = np.array([1000003**k % (1 << 63) for k in range(SHINGLE)], dtype=np.uint64)
_ID, _NUM, _STR = 1, 2, 3
_CODE = {w: k + 64 for k, w in enumerate(_KEYWORDS)} | dict.fromkeys(("int", "long", "char", "boolean", "double", "float", "string", "number"), _ID)


def masked_tokens(text: str, hash_comments: bool) -> np.ndarray:
    """Codes of the tokens of a source text: identifiers, numbers and strings by kind only, words of languages and signs as they are."""
    out = []
    code = _CODE
    for t in _TOKEN.findall(text):
        k = code.get(t)
        if k is None:
            c = t[0]
            if c == "/" and len(t) > 1 or c == "#" and hash_comments:
                continue
            if c in "\"'`" and len(t) > 1:
                k = _STR
            elif c.isdigit():
                k = _NUM
            elif c.isalpha() or c in "_$":
                k = _ID
            else:
                k = 1000 + ord(c)
            if len(t) == 1:
                code[t] = k
        out.append(k)
    return np.array(out, dtype=np.uint64)


def shingles(codes: np.ndarray) -> np.ndarray:
    """Distinct hashes of the runs of five tokens; a shorter text is one run."""
    if not len(codes):
        return np.zeros(0, dtype=np.uint32)
    if len(codes) < SHINGLE:
        codes = np.concatenate([codes, np.zeros(SHINGLE - len(codes), dtype=np.uint64)])
    h = np.zeros(len(codes) - SHINGLE + 1, dtype=np.uint64)
    for k in range(SHINGLE):
        h += codes[k : len(codes) - SHINGLE + 1 + k] * _POLY[k]
    h ^= h >> np.uint64(29)
    return np.unique((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


_BLANK = re.compile(r"[\s\ufeff]+")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)|<!--.*?(?:-->|\Z)|\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|(?://|\#|--(?!-))[^\n]*", re.S)
#: what may stand before or between the comments at the top: declarations of package and imports, marks of a document, shell options
_PREAMBLE = re.compile(
    r"(?:package|using|option|syntax|namespace)\b[^;{\n]*(?:;|(?=\n)|\Z)|import[ \t]*\([^)]*\)|(?:import|export)\b[^;\n{(=]*\{[^{}]*\}[ \t]*from[^;\n]*;?|import\b[^;\n]*;?|from[ \t]+[\w.]+[ \t]+import[ \t]*(?:\([^)]*\)|[^\n]*)"
    r"|(?:(?:const|var|let)\b[^;\n=]*=[ \t]*)?require\([^)\n]*\);?|'use strict';?|\"use strict\";?|<\?.*?\?>|<!doctype[^>]*>|<(?:project|html|beans|configuration|root)\b[^>]*>|-{3}(?=\s|\Z)|set[ \t]+[-+][^\n]*", re.S | re.I
)

_OPENING = re.compile(r"[^\n]*[{(\[][ \t]*(?=\n)")


def _head(text: str) -> list[str]:
    """The lines of all comments before the code begins, however many there are, and each pair of lines that follow each other in one comment.

    A first line that only opens the file's one table or class (``export const X = {``) is not yet code.
    """
    found, i, last, opened = [], 0, -1, False
    while i < len(text):
        if m := _BLANK.match(text, i):
            pass
        elif m := _COMMENT.match(text, i):
            lines = [s for s in map(str.strip, m.group().split("\n")) if s.strip("*/#-<>! ")]
            if last == m.start() and found and lines and len(lines) == 1:
                lines = [found[-1], *lines]  # a run of line comments is one block
                pairs = [" ".join((lines[0], lines[1].lstrip("*/#- ")))]
                found += [pairs[0], lines[1]]
            else:
                for k, s in enumerate(lines):
                    found += ([" ".join((lines[k - 1], s.lstrip("*/#- ")))] if k else []) + [s]
            nl = re.compile(r"\n[ \t]*").match(text, m.end())
            last = nl.end() if nl and len(lines) else -1
        elif m := _PREAMBLE.match(text, i):
            pass
        elif not opened and (m := _OPENING.match(text, i)):
            opened = True
        else:
            break
        i = m.end()
    return found


def projects_of(rel_path: str | None, text: str) -> tuple[list[str], list[str]]:
    """(folders right below a folder for outside code, those of them that surely are outside projects).

    Sure is a folder of a path with a folder that only tools fill, and one that the file's own package or its imports
    name, unless these name Northmere too. A bare Python import proves nothing: modules of this organisation look alike.
    """
    parts = (rel_path or "").replace("\\", "/").lower().split("/")
    found = list(dict.fromkeys(parts[k + 1] for k in range(len(parts) - 2) if parts[k] in _VENDOR_DIRS and parts[k + 1] not in _VENDOR_DIRS))
    if not found or not _SURE_DIRS.isdisjoint(parts[:-1]):
        return found, found
    roots = {x.replace("-", "").replace("_", "") for m in _ROOTS.findall(text) for root in m if root for x in re.split(r"[./@]", root.lower())}
    return found, [] if _OWN in roots else [x for x in found if x not in _LAYOUT and x.replace("-", "").replace("_", "") in roots]


def minified(text: str, codes: np.ndarray) -> bool:
    """Whether code was shortened by a tool: many tokens a line, hardly a blank between them, and names cut short where blanks are less rare.

    Comments and strings do not count, so neither a banner nor long messages hide it; tables of literals are not meant.
    """
    n = len(codes)
    if not n or (codes > 1000).sum() <= 0.3 * n or not (codes >= 64).any() or (codes == _ID).sum() <= 0.15 * n:
        return False
    code = _TOKEN.sub(lambda m: "" if len(m.group()) > 1 and (m.group()[0] in "\"'`#" or m.group()[:2] in ("//", "/*")) else m.group(), text).strip()
    lines = [x for x in code.split("\n") if x.strip()]
    density = sum(map(code.count, " \t\r\n")) / max(1, len(code))
    if not lines or n < 25 * len(lines) or density >= 0.1:
        return False
    names = re.findall(r"[^\W\d][\w$]*", code)
    short = sum(map(len, names)) / max(1, len(names))
    return density < 0.06 or short < 5


def marks(rel_path: str | None, text: str, codes: np.ndarray) -> tuple[bool, str | None, bool, bool, bool]:
    """(generated notice, outside project of the header, minified, literals only, own notice)."""
    gen, outside, own = False, None, False
    for s in _head(text):
        gen = gen or bool(_GENERATED.search(s))
        own = own or _OWN in s.lower()
        if outside is None and (m := _OUTSIDE.search(s)):
            name = next(x for x in m.groups() if x).lower()
            outside = name if name != _OWN else None
    mini = minified(text, codes)
    words = int((codes < 1000).sum())
    literals = int(((codes == _NUM) | (codes == _STR)).sum())
    blob = words >= 24 and literals >= 0.9 * words
    if not blob and 2 <= words and literals and len(text) > 600:
        others = [x for x in _TOKEN.findall(text) if x[0].isalpha()]
        blob = len(others) <= 12 and sum(len(x) for x in _TOKEN.findall(text) if x[0] in "\"'`") > 0.8 * len(text)
    blob = blob and (rel_path or "").rsplit(".", 1)[-1].lower() not in _DATA_NAMES
    return gen, outside, mini, blob, own


_FEATURES = "file_id long, scanned_at timestamp, repo string, path string, gen boolean, outside string, mini boolean, blob boolean, projects array<string>, sure array<string>, own boolean, dirs array<string>, shape long, shingles array<int>"


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for file_id, at, repo, path, ct, text in zip(b.file_id, b.scanned_at, b.repo, b.rel_path, b.content_type, b.content):
            name = (path or "").rsplit("/", 1)[-1]
            codes = masked_tokens(text, (ct or "") in ("python", "bash", "spring_yaml") or name.endswith((".py", ".sh", ".yml", ".yaml")))
            sh = shingles(codes)
            gen, outside, mini, blob, own = marks(path, text, codes)
            projects, sure = projects_of(path, text)
            shape = int(np.bitwise_xor.reduce(sh.astype(np.uint64) * _ODD).astype(np.int64)) if len(sh) else 0
            parts = (path or "").replace("\\", "/").lower().split("/")[:-1]
            rows.append((file_id, at, repo, path, gen, outside, mini, blob, projects, sure, own, parts, shape, sh.astype(np.int32).tolist()))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _FEATURES.split(", ")])


def _prefixes(table, similarity: float):
    """(shape, n, map, prefix) of each set of shingles: its size, the words of its parity map and its prefix, rarest first by the broadcast table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log = np.frombuffer(table.value, dtype=np.uint8)
        for b in batches:
            rows = []
            for shape, sh in zip(b["shape"], b["sh"]):
                sh = np.asarray(sh, dtype=np.int64)
                order = np.lexsort((sh, log[_cell(sh, CELLS)]))[: len(sh) - int(np.ceil(similarity * len(sh) - 1e-9)) + 1]
                rows.append((shape, len(sh), parity_map(sh, BITS).view(np.int64), sh[order]))
            yield pd.DataFrame(rows, columns=["shape", "n", "map", "prefix"])

    return run


def alike_shapes(feats: DataFrame, noticed: DataFrame, similarity: float) -> DataFrame:
    """(shape, rep): every pair of a shape and a noticed shape that may be alike, each noticed shape with itself too.

    Sets of Jaccard similarity ``similarity`` or more share a shingle of their prefixes, taken in one order for all. Pairs
    are left by their sizes, by what can follow the first shingle they share, and by the distance of their parity maps,
    none of which rules out a pair that is alike; so no pair is lost, however many noticed shapes share a shingle.
    """
    spark = feats.sparkSession
    rows = feats.where("NOT blob AND NOT mini AND size(shingles) > 0").select("shape", "gen", F.transform("shingles", lambda x: F.shiftleft(x.cast("long"), 32)).alias("sh"))
    table = spark.sparkContext.broadcast(_table(rows, "sh", CELLS, None, _log))

    def spots(sets: DataFrame) -> DataFrame:
        return sets.select("shape", "sh").mapInPandas(_prefixes(table, similarity), "shape long, n int, map array<long>, prefix array<long>")

    # a noticed shape has a row with a notice, so few rows are read for these
    reps = spots(rows.where("gen")).join(noticed, "shape", "left_semi").dropDuplicates(["shape"])
    reps = cut(reps.select(F.col("shape").alias("rep"), F.col("n").alias("rn"), F.col("map").alias("rmap"), F.posexplode("prefix").alias("rpos", "h")))
    apart = sum((F.bit_count(F.col("map")[k].bitwiseXOR(F.col("rmap")[k])) for k in range(BITS // 64)), F.lit(0))
    able = (
        (F.least("n", "rn") >= similarity * F.greatest("n", "rn") - 1e-9)
        & (F.least(F.col("n") - F.col("pos"), F.col("rn") - F.col("rpos")) * (1 + similarity) >= similarity * (F.col("n") + F.col("rn")) - 1e-9)
        & (apart * (1 + similarity) <= (F.col("n") + F.col("rn")) * (1 - similarity) + 1e-9)
    )
    near = spots(rows).select("shape", "n", "map", F.posexplode("prefix").alias("pos", "h"))
    return near.join(reps, "h").where(able).select("shape", "rep").distinct()


def clean_path(c):
    """A path as it is written in source_files: forward slashes, no leading ./ or /, no doubled slash."""
    c = F.regexp_replace(F.trim(c), r"\\", "/")
    return F.regexp_replace(F.regexp_replace(c, "/{2,}", "/"), r"^(?:\./|/)+", "")


def not_hand_written(files: DataFrame, ingested: DataFrame, repositories: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(tab, row_id) of the files that are generated, minified, third-party or data, and of their ingested_files rows.

    Files of one set of identifier-masked token shingles are one shape. Every noticed shape is compared with every shape
    alike to it (Jaccard of the shingle sets >= ``similarity``, exact); pairs of two shapes without notice are never
    listed, so neither is a hot family's inner square. Where a fifth of the files that agree with a noticed shape carry
    notices of a tool, those without are cases too.
    Outside projects are named by all headers of the table, by folders that only tools fill and by the package roots of
    files in other folders for outside code; the paths are read with those names.
    Clusters spread notices of tools only; all else is decided per file (see README for what that leaves out).
    Rows of one file_id count once (the latest scanned_at). Null content: never a case. Null paths match nothing.
    Empty text: no shingles, no case. Empty tables give no rows. Extra columns are ignored.
    """
    base = files.where("content IS NOT NULL AND file_id IS NOT NULL").select("file_id", "scanned_at", "repo", "rel_path", "content_type", "content")
    feats = base.mapInPandas(_features, _FEATURES)
    feats = cut(feats)
    # the rows of one file: all but a few keys have one, so only keys with more go through the choice of the latest
    last = feats.groupBy("file_id").agg(F.max(F.struct(F.coalesce("scanned_at", F.lit("0001-01-01").cast("timestamp")).alias("at"), "shape", "path", "gen", "outside", "mini", "blob", "projects", "sure", "own", "repo", "dirs")).alias("r"))
    one = cut(last.select("file_id", "r.shape", "r.path", "r.gen", "r.outside", "r.mini", "r.blob", "r.projects", "r.sure", "r.own", "r.repo", "r.dirs"))
    # 1. families: every noticed shape is compared with all shapes that may be alike to it, and the notices are counted after that
    shapes = one.where("NOT blob AND NOT mini").groupBy("shape").agg(F.min("file_id").alias("file_id"), F.count("*").alias("n"), F.sum(F.col("gen").cast("long")).alias("n_gen"))
    pairs = cut(alike_shapes(feats, shapes.where("n_gen > 0").select("shape"), similarity))
    # the content of one file stands for each shape; only shapes that some pair needs bring their shingles
    needed = cut(shapes.join(pairs.select("shape").distinct(), "shape", "left_semi"))
    sets = feats.select("file_id", "shape", "shingles").join(needed, ["file_id", "shape"]).dropDuplicates(["shape"])
    others = sets.select(F.col("shape").alias("rep"), F.col("shingles").alias("other"))
    inter = F.size(F.array_intersect("shingles", "other"))
    alike = pairs.join(sets, "shape").join(others, "rep").where(inter >= similarity * (F.size("shingles") + F.size("other") - inter)).select("shape", "rep", "n", "n_gen")
    alike = cut(alike)
    noticed = alike.groupBy("rep").agg(F.sum("n").alias("n"), F.sum("n_gen").alias("n_gen")).where("n_gen >= 0.2 * n").select("rep")
    family = one.where("NOT gen AND NOT blob AND NOT mini").join(alike.join(noticed, "rep", "left_semi").select("shape").distinct(), "shape", "left_semi").select("file_id")
    # 2. outside projects named by headers; their number follows the projects, not the files
    names = one.where("outside IS NOT NULL").select(F.col("outside").alias("name")).distinct()
    by_path = one.where("outside IS NULL AND NOT own").select("file_id", F.explode(F.array_distinct("dirs")).alias("name")).join(names, "name").select("file_id").distinct()
    sure = one.where("NOT own").select(F.explode("sure").alias("name")).where(~F.col("name").isin(*_LAYOUT)).distinct()
    by_folder = one.where("outside IS NULL AND NOT own").select("file_id", F.explode("projects").alias("name")).join(sure, "name").select("file_id").distinct()
    marked = one.where("gen OR mini OR blob OR outside IS NOT NULL OR (NOT own AND size(sure) > 0)").select("file_id")
    found = cut(marked.unionByName(family).unionByName(by_path).unionByName(by_folder).distinct().join(one.select("file_id", "repo", "path"), "file_id"))
    repos = repositories.where("id IS NOT NULL AND name IS NOT NULL").select(F.col("id").alias("repository_id"), F.col("name").alias("repo")).distinct()
    there = ingested.where("id IS NOT NULL").select("id", "repository_id", clean_path(F.col("rel_path")).alias("path")).join(repos, "repository_id")
    hit = there.join(found.select("repo", clean_path(F.col("path")).alias("path")).distinct(), ["repo", "path"], "left_semi")
    return found.select(F.lit("source_files").alias("tab"), F.col("file_id").cast("long").alias("row_id")).unionByName(
        hit.select(F.lit("ingested_files").alias("tab"), F.col("id").cast("long").alias("row_id")).distinct()
    )


# ---- problem 2 ----------------------------------------------------------------------------------------------
_CHECKED = "file_id long, scanned_at timestamp, repo string, lang string, bad boolean"


def _check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from corpusloom.llm import syntax

    for b in batches:
        rows = []
        for file_id, at, repo, path, ct, text in zip(b.file_id, b.scanned_at, b.repo, b.rel_path, b.content_type, b.content):
            lang = syntax.language(ct, path)
            rows.append((file_id, at, repo, lang, text is not None and lang is not None and not syntax.valid(lang, text)))
        yield pd.DataFrame(rows, columns=["file_id", "scanned_at", "repo", "lang", "bad"])


def checked_files(files: DataFrame) -> DataFrame:
    """(file_id, repo, lang, bad): each file once, ``bad`` if every dialect of its language rejects the latest content.

    The check runs where the scan put the rows; only its verdict is shuffled. Files of other types, of null content
    or of no known language are never bad (lang is null for the last). An empty text is a valid empty file, except
    where the language needs a document (JSON, XML, Go).
    """
    rows = files.where("file_id IS NOT NULL").select("file_id", "scanned_at", "repo", "rel_path", "content_type", "content").mapInPandas(_check, _CHECKED)
    r = F.struct(F.coalesce("scanned_at", F.lit("0001-01-01").cast("timestamp")).alias("at"), "bad", "repo", "lang")
    return rows.groupBy("file_id").agg(F.max(r).alias("r")).select("file_id", "r.repo", "r.lang", "r.bad")


def unparsable(files: DataFrame) -> DataFrame:
    """(file_id) of the files whose content is not valid in the language they claim."""
    return checked_files(files).where("bad").select(F.col("file_id").cast("long").alias("file_id"))


def parse_rates(files: DataFrame, runs: DataFrame, repositories: DataFrame) -> DataFrame:
    """Per repository and language: files, bad files, their share, and the status of the repository's last ingestion run.

    Status spellings are folded to lower case without blanks; no run or a null status gives 'unknown'.
    """
    c = checked_files(files).where("lang IS NOT NULL")
    rates = c.groupBy("repo", "lang").agg(F.count("*").alias("n_files"), F.sum(F.col("bad").cast("long")).alias("n_bad"))
    last = runs.where("repository_id IS NOT NULL").groupBy("repository_id").agg(F.max(F.struct("started_at", "id", F.lower(F.trim("status")).alias("status"))).alias("r"))
    status = last.join(repositories.select(F.col("id").alias("repository_id"), F.col("name").alias("repo")), "repository_id").groupBy("repo").agg(F.max("r.status").alias("last_status"))
    return rates.join(status, "repo", "left").select("repo", "lang", "n_files", "n_bad", F.round(F.col("n_bad") / F.col("n_files"), 6).alias("bad_share"), F.coalesce("last_status", F.lit("unknown")).alias("last_status"))
