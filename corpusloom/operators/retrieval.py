"""Ranked retrieval: lexical, BM25 and dense top-k, fusion of ranked lists, learned boosts, and the hybrid of all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

#: constants of fusion, of the bonus of one collection, and of the range of boosts
RRF_K, BONUS, BOOST_LOW, BOOST_HIGH = 60, 0.25, -0.4, 0.5
K1, B = 1.2, 0.75


def _query_terms(query: str) -> list[str]:
    import re

    return sorted({t for t in re.findall(T.TERM, query.lower())})


def _equals(term: str):
    return lambda x: x == F.lit(term)


def lexical_rank(chunks: DataFrame, query: str, k: int) -> DataFrame:
    """(id, score) of the k best by coverage of the query's terms plus a tenth of their density; ties fall to the smaller id.

    Null and empty texts score 0, as does everything for a query without terms. Planned as one scan with a bounded top-k: no shuffle.
    """
    q = F.array(*[F.lit(t) for t in _query_terms(query)]).cast("array<string>")
    terms = T.terms(F.col("text"))
    hits = F.size(F.filter("t", lambda t: F.array_contains(q, t)))
    score = F.when((F.size("t") == 0) | (F.size(q) == 0), 0.0).otherwise(F.size(F.array_intersect(q, F.col("t"))) / F.size(q) + 0.1 * hits / F.size("t"))
    return chunks.select("id", terms.alias("t")).select("id", F.round(score, 9).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def bm25_topk(chunks: DataFrame, query: str, k: int) -> DataFrame:
    """(id, score) of the k best by BM25 over the query's terms; rows without a term are left out.

    One aggregate over the collection gives its size, mean length and the document frequency of each query term: a
    single row of as many numbers as the query has terms comes to the driver. Scores need no shuffle then.
    """
    q = _query_terms(query)
    d = chunks.select("id", T.terms(F.col("text")).alias("t"))
    d = d.select("id", F.size("t").alias("n"), *[F.size(F.filter("t", _equals(w))).alias(f"f{j}") for j, w in enumerate(q)])
    s = d.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *[F.sum((F.col(f"f{j}") > 0).cast("long")).alias(f"d{j}") for j in range(len(q))]).first()
    if not q or not s["docs"] or not s["mean"]:
        return d.select("id", F.lit(0.0).alias("score")).where("false")
    idf = [F.lit(s["docs"] - s[f"d{j}"] + 0.5) / F.lit(s[f"d{j}"] + 0.5) for j in range(len(q))]
    parts = [F.log(1 + w) * F.col(f"f{j}") * (K1 + 1) / (F.col(f"f{j}") + K1 * (1 - B + B * F.col("n") / F.lit(float(s["mean"])))) for j, w in enumerate(idf)]
    score = F.round(reduce(Column.__add__, parts), 9)
    return d.select("id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of doubles; 0 when either has length 0."""

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def dense_topk(vectors: DataFrame, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """(id, score) of the k nearest by cosine, exact over all rows; a filter comes before the ranking. Vectors of another length are an error."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = vectors.where(where) if where is not None else vectors
    e = F.col("embedding").cast("array<double>")
    right = F.when(F.size(e) == len(query), e).otherwise(F.raise_error(F.lit("vector of another dimension")).cast("array<double>"))
    return v.where("embedding IS NOT NULL").select("id", F.round(cosine(right, q), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def rrf(lists: list[DataFrame], collections: DataFrame | None = None, favoured: str = "semantic", k: int = RRF_K) -> DataFrame:
    """(id, score): the sum of 1 / (k + rank) over the lists, ranks from 1 by score then id; ids of the favoured collection gain a quarter.

    The lists are bounded top-k results, so the ranks are taken over a few rows.
    """
    ranked = [d.select("id", (1.0 / (k + F.row_number().over(Window.orderBy(F.desc("score"), "id")))).alias("s")) for d in lists]
    fused = reduce(DataFrame.unionByName, ranked).groupBy("id").agg(F.sum("s").alias("score"))
    if collections is not None:
        fused = fused.join(collections.select("id", "collection"), "id", "left").select("id", (F.col("score") + F.when(F.col("collection") == favoured, BONUS).otherwise(0.0)).alias("score"))
    return fused


def boosted(hits: DataFrame, by_id: DataFrame, by_path: DataFrame) -> DataFrame:
    """(id, path, score) with score times 1 + the sum of the boosts of id and path, held between -0.4 and 0.5."""
    b = F.coalesce("bi", F.lit(0.0)) + F.coalesce("bp", F.lit(0.0))
    held = F.greatest(F.lit(BOOST_LOW), F.least(F.lit(BOOST_HIGH), b))
    return hits.join(by_id.select("id", F.col("boost").alias("bi")), "id", "left").join(by_path.select("path", F.col("boost").alias("bp")), "path", "left").select("id", "path", (F.col("score") * (1 + held)).alias("score"))


def hybrid_retrieve(chunks: DataFrame, vectors: DataFrame, query: str, vector: list[float], k: int = 20, pool: int = 60) -> DataFrame:
    """(id, collection, score) of the k best of the fusion of lexical, BM25 and dense lists of ``pool`` rows each."""
    lists = [lexical_rank(chunks, query, pool), bm25_topk(chunks, query, pool), dense_topk(vectors, vector, pool)]
    fused = rrf(lists, chunks.select("id", "collection"), "wiki")
    return fused.join(chunks.select("id", "collection"), "id").select("id", "collection", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)
