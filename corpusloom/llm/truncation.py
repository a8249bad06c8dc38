"""Problem 10: texts cut off by field limits or in transfer, by length hazards and incomplete endings."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.tables import cut, spread

#: lengths to either side whose hazards a length's own is tested against; share of false discoveries allowed; least excess
NEIGHBOURS, FDR, LEAST = 40, 0.01, 3
#: least share of cut signs among a source's unterminated endings for all of these to count as cut
SIGNS = 0.25
# ---- fixed values: marks of a cut, and words on which no sentence ends ------------------------------------------
_MARK = re.compile(
    r"(?i)(?:[\[(<]\s*(?:\.{3}|…)\s*[\])>]|…|(?<!\.)\.{3}|&hellip;|(?:[\[(<]|^[=\-*#~ ]+|(?<=\n)[=\-*#~ ]*)\s*(?:(?:message|text|content|mail|output|body|entry)\s+)?(?:clipped|truncated|cut off|shortened|gekürzt|tronqué|truncado)[\])>=\-*~ .]*"
    r"|(?:[\[(<]|(?<=\n)[=\-*#~ ]*)\s*(?:transfer|transmission|connection|stream)\s+(?:aborted|interrupted|lost|reset|closed)[\])>=\-*~ .]*)\s*$"
)
_OPEN_WORDS = set(
    "the a an this that these those of to in on at by for from with without into onto and or nor but if when while until because since whether which who whose than as is are was were be been being has have had do does did can could will would shall should may might must not no every each some any its his her their our your my it they we you he she unless after before whenever "
    "der die das den dem des ein eine einen einem einer und oder aber mit von zu zum zur im am auf aus bei für nach über unter vor dass weil wenn als bis ist war wird nicht auch "
    "el la los las un una unos unas de del al y o pero con por para sin sobre que cuando porque se su sus es era fue no también "
    "le les des du au aux et ou mais avec pour sans sur dans par qui dont où est était sera ne pas ce cette ces son sa leur n l d qu j s".split()
)
# ------------------------------------------------------------------------------------------------------------------
_CLOSED = re.compile(r"[.!?。！？:;][\"'”’»)\]`*_]*$")
_LISTED = re.compile(r"^\s*(?:[-*+•] |\d+[.)] |#{1,6} |>|\||--|See also|https?://|```|~~~|\[[^\]]*\]:)")
_SIGNED = re.compile(r"^\s*(?:--|—)\s?\S|(?i:^\s*(?:regards|best|thanks|cheers|gruß|viele grüße|saludos|cordialement)\b)")
_LINK = re.compile(r"https?://\S+$")
_LAST = re.compile(r"([^\W\d_]+)$")


def ending(text: str) -> tuple[str, str]:
    """(how a text ends, its last word in lower case or ''): empty, mark, open, closed, listed (list, table, link, signature, code) or bare.

    ``open`` is surely cut: an unclosed code fence or table row, a trailing comma or a word on which nothing ends.
    """
    t = text.rstrip()
    if not t:
        return "empty", ""
    m = _MARK.search(t)
    if m:
        return "mark", ""
    line = t[t.rfind("\n") + 1 :]
    word = _LAST.search(t)
    word = word[1].lower() if word else ""
    fences = len(re.findall(r"^\s*(?:```|~~~)", t, re.M))
    if fences % 2:
        return "open", word
    if line.lstrip().startswith("|") and not line.rstrip().endswith("|"):
        return "open", word
    if _CLOSED.search(line):
        return "closed", word
    if word in _OPEN_WORDS and re.match(r"\s*(?:[-*+•]|\d+[.)]) ", line):
        return "open", word
    if _LINK.search(line) or _SIGNED.match(line) or _LISTED.match(line) or line.lstrip().startswith(("```", "~~~")) or re.match(r"^\s*[}\])]+[;,]?$", line):
        return "listed", word
    before = t[: t.rfind("\n")] if "\n" in t else ""
    if before.count("```") % 2 == 0 and re.search(r"[{};=]$|^\s*(?:import|from|package)\b.*[;\w]$", line) and line[-1] in "};{":
        return "listed", word
    if line[-1] in ",-–(/" or word in _OPEN_WORDS or text != t and text[-1] == " " and not text.endswith("  "):
        return "open", word
    return "bare", word


def _endings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        e = [ending(t) for t in b["text"]]
        yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "chars": b["text"].str.len(), "bytes": [len(t.encode()) for t in b["text"]], "kind": [x for x, _ in e], "word": [w for _, w in e], "same": b["same"]})


def _tail(n: float, mean: float) -> float:
    """P(X >= n) of a Poisson variable, by its series from n on."""
    if n <= 0 or mean <= 0:
        return 1.0 if n <= 0 else 0.0
    log = -mean + n * math.log(mean) - math.lgamma(n + 1)
    term, total, k = 1.0, 1.0, n
    while term > 1e-15 * total:
        k += 1
        term *= mean / k
        total += term
        if k > n + 10_000:
            break
    return min(1.0, math.exp(log) * total) if log > -740 else 0.0


def length_tests(docs: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(source, measure, length, n, at_risk, expected, p): each length's hazard, n of the texts of at least that length, against that of its neighbours.

    Counted by source in characters and in bytes of UTF-8; windows run over the counts, one row a length, not over texts.
    """
    both = F.explode(F.array(F.struct(F.lit("chars").alias("measure"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("measure"), F.col("bytes").alias("length")))).alias("m")
    texts = docs.select("source", "chars", "bytes", "same").distinct()  # copies of one text are one ending
    n = texts.select("source", both).groupBy("source", "m.measure", "m.length").agg(F.count("*").alias("n"))
    by = Window.partitionBy("source", "measure").orderBy("length")
    n = n.withColumn("at_risk", F.sum("n").over(by.rangeBetween(0, Window.unboundedFollowing)))
    near = by.rangeBetween(-neighbours, neighbours)
    # the mean hazard around a length, itself left out, over all lengths there whether texts have them or not
    width = F.least(F.col("length"), F.lit(neighbours)) + neighbours
    hazard = (F.sum(F.col("n") / F.col("at_risk")).over(near) - F.col("n") / F.col("at_risk")) / width
    n = n.withColumn("expected", F.greatest(hazard, F.lit(0.5) / (width * F.col("at_risk"))) * F.col("at_risk"))

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["p"] = [_tail(x, m) for x, m in zip(b["n"], b["expected"])]
            yield b

    return n.mapInPandas(test, "source string, measure string, length int, n long, at_risk long, expected double, p double")


def limits(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """(source, measure, length) at which significantly many texts end: Benjamini and Hochberg's step-up over all tested lengths."""
    t = cut(length_tests(docs))
    m = t.count()
    # a p-value's rank counts those that are no greater; only candidates below the rate can pass
    small = t.where(F.col("p") <= fdr).withColumn("rank", F.rank().over(Window.orderBy(F.col("p").desc())))
    k = small.count()
    passed = small.withColumn("ok", F.col("p") <= fdr * (k + 1 - F.col("rank")) / max(1, m))
    bound = passed.where("ok").agg(F.max("p")).first()[0]
    return t.where((F.col("p") <= (bound if bound is not None else -1.0)) & (F.col("n") >= LEAST)).select("source", "measure", "length")


def judged(documents: DataFrame) -> DataFrame:
    """(doc_id, source, kind, at_limit, sign, is_cut) of every document with a text.

    Cut is a text with a mark of a cut; a text at a significant length of its source whose ending is not closed (a byte limit
    also takes texts that end up to 3 bytes before it, where a character did not fit); a text with an open ending, or
    whose last word stands nowhere else in the corpus but begins a longer word there (it was cut inside); and where such signs are a quarter of a source's
    unterminated endings, all its bare endings. In other sources (informal ones) bare endings are complete.
    Null and empty texts are no cases; a null source is a source of its own. Repeated doc_ids count once, as cut if one
    row is. Empty tables give no rows; extra columns are ignored.
    """
    rows = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text", F.xxhash64("text").alias("same"))
    e = cut(spread(rows).mapInPandas(_endings, "doc_id long, source string, chars int, bytes int, kind string, word string, same long").where("kind <> 'empty'"))
    at = limits(e)
    full = at.select("source", "measure", "length", F.explode(F.when(F.col("measure") == "bytes", F.array(*[F.col("length") - k for k in range(4)])).otherwise(F.array("length"))).alias("l"))
    keys = full.where((F.col("measure") == "chars") | (F.col("l") == F.col("length"))).select("source", F.col("measure"), F.col("l"), F.lit(False).alias("short")).unionByName(
        full.where((F.col("measure") == "bytes") & (F.col("l") < F.col("length"))).select("source", "measure", "l", F.lit(True).alias("short"))
    )
    rows = rows.drop("same")
    hit = e.where("kind <> 'closed'").select("doc_id", "source", (F.col("bytes") > F.col("chars")).alias("wide"), F.explode(F.array(F.struct(F.lit("chars").alias("measure"), F.col("chars").alias("l")), F.struct(F.lit("bytes").alias("measure"), F.col("bytes").alias("l")))).alias("m"))
    hit = hit.select("doc_id", "source", "wide", "m.measure", "m.l").join(keys, ["source", "measure", "l"]).where("NOT short OR wide").select("doc_id").distinct().withColumn("at_limit", F.lit(True))
    # words of the whole corpus that stand before something else; only those that end a doubtful text matter
    ends = e.where("kind IN ('bare', 'listed') AND word <> ''").select("word").distinct()
    inner = rows.select(F.explode(F.split(F.lower(F.regexp_replace("text", r"[\p{L}]+\s*$", "")), r"[^\p{L}]+")).alias("word")).groupBy("word").agg(F.lit(True).alias("known"))
    inner = cut(inner.where("word <> ''"))
    known = ends.join(inner, "word")
    # and those that begin a longer word
    begins = ends.join(inner.where("length(word) > 1").select(F.explode(F.expr("transform(sequence(1, length(word) - 1), k -> substring(word, 1, k))")).alias("word")), "word", "left_semi").select("word", F.lit(True).alias("begins"))
    j = e.join(hit, "doc_id", "left").join(known, "word", "left").join(begins, "word", "left").withColumn("at_limit", F.coalesce("at_limit", F.lit(False)))
    partial = (F.col("word") != "") & F.col("known").isNull() & F.col("begins").isNotNull() & F.col("kind").isin("bare", "listed")
    j = j.withColumn("sign", (F.col("kind") == "open") | partial)
    j = cut(j.select("doc_id", "source", "kind", "at_limit", "sign"))
    per = j.where("NOT at_limit AND kind IN ('bare', 'open')").groupBy("source").agg((F.sum(F.col("sign").cast("long")) >= SIGNS * (F.count("*") + 1)).alias("cuts"))
    j = j.join(per, "source", "left")
    is_cut = (F.col("kind") == "mark") | F.col("at_limit") & (F.col("kind") != "closed") | F.col("sign") | (F.col("kind") == "bare") & F.coalesce("cuts", F.lit(False))
    j = j.withColumn("is_cut", is_cut)
    return j.groupBy("doc_id").agg(F.max("source").alias("source"), F.max("kind").alias("kind"), F.max("at_limit").alias("at_limit"), F.max("sign").alias("sign"), F.max("is_cut").alias("is_cut"))


def truncated(documents: DataFrame) -> DataFrame:
    """(doc_id) of the documents whose text was cut (see ``judged``)."""
    return judged(documents).where("is_cut").select("doc_id")


def truncation_rates(documents: DataFrame) -> DataFrame:
    """(source, n_docs, n_cut, cut_share) of the documents with a text, per source."""
    return judged(documents).groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("is_cut").cast("long")).alias("n_cut")).withColumn("cut_share", F.round(F.col("n_cut") / F.col("n_docs"), 6))
