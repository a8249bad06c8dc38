"""The log of interactions: signals, boosts, features, previous questions, co-change of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

#: step of a signal, share of it for a negative one, and the range of a boost
STEP, NEGATIVE, LOW, HIGH = 0.25, 0.7, -0.4, 1.0


def signals(events: DataFrame) -> DataFrame:
    """(id, sign, weight, chunk_ids, paths): ratings of 4 and more are positive, of 2 and less negative, with weight 1; without such a rating the implicit mark, with weight 0.5."""
    sign = F.when(F.col("rating") >= 4, 1).when(F.col("rating") <= 2, -1).when(F.col("implicit") == "positive", 1).when(F.col("implicit") == "negative", -1)
    weight = F.when((F.col("rating") >= 4) | (F.col("rating") <= 2), 1.0).otherwise(0.5)
    return events.select("id", "ts", sign.alias("sign"), weight.alias("weight"), "chunk_ids", "paths").where("sign IS NOT NULL")


def boosts(events: DataFrame, keys: str) -> DataFrame:
    """(key, boost, n): signals summed per chunk or path, a quarter of the weight each, 0.7 of that downwards, held to [-0.4, 1]."""
    s = signals(events).select(F.explode(F.array_distinct(keys)).alias("key"), F.when(F.col("sign") > 0, STEP * F.col("weight")).otherwise(-STEP * NEGATIVE * F.col("weight")).alias("d"))
    g = s.where("key IS NOT NULL").groupBy("key").agg(F.sum("d").alias("d"), F.count("*").alias("n"))
    return g.select("key", F.round(F.greatest(F.lit(LOW), F.least(F.lit(HIGH), F.col("d"))), 4).alias("boost"), "n")


def features(events: DataFrame) -> DataFrame:
    """(key, n_pos, n_neg, n_events, avg_conf, label) of every chunk an event names."""
    s = events.select("rating", "implicit", "confidence", F.explode(F.array_distinct("chunk_ids")).alias("key")).where("key IS NOT NULL")
    pos = ((F.col("rating") >= 4) | (F.col("rating").isNull() & (F.coalesce("implicit", F.lit("")) == "positive"))).cast("long")
    neg = ((F.col("rating") <= 2) | (F.col("rating").isNull() & (F.coalesce("implicit", F.lit("")) == "negative"))).cast("long")
    g = s.groupBy("key").agg(F.sum(F.coalesce(pos, F.lit(0))).alias("n_pos"), F.sum(F.coalesce(neg, F.lit(0))).alias("n_neg"), F.count("*").alias("n_events"), F.round(F.avg("confidence") + 1e-9, 6).alias("avg_conf"))
    return g.withColumn("label", (F.col("n_pos") > F.col("n_neg")).cast("int"))


def rephrased(events: DataFrame, within: int = 900, low: float = 0.25) -> DataFrame:
    """(id, previous_id, gap_s, similarity): questions of one intent asked again in other words soon after, by lag over time.

    The window is partitioned by intent and day, so no task holds the whole log; a pair across midnight is not seen.
    """
    w = Window.partitionBy("intent", F.to_date("ts")).orderBy("ts", "id")
    e = events.where("ts IS NOT NULL AND intent IS NOT NULL").select("id", "ts", "intent", F.array_distinct(T.learning_terms(F.col("question"))).alias("t"))
    e = e.select("id", F.lag("id").over(w).alias("previous_id"), (F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w))).alias("gap_s"), "t", F.lag("t").over(w).alias("p"))
    return e.select("id", "previous_id", "gap_s", F.round(T.jaccard(F.col("t"), F.col("p")), 6).alias("similarity")).where(f"gap_s >= 0 AND gap_s < {within} AND similarity >= {low}")


def coupling(events: DataFrame, least: int = 2, low: int = 2, high: int = 20) -> DataFrame:
    """(path_a, path_b, together, coupling): pairs of paths of one event, with their count over the smaller count of either path.

    Events of ``low`` to ``high`` paths count, so an event yields at most 190 pairs; pairs are counted map-side.
    """
    e = events.select("id", F.array_sort(F.array_distinct(F.filter("paths", lambda p: p.isNotNull()))).alias("ps")).where(f"size(ps) BETWEEN {low} AND {high}")
    n = e.select(F.explode("ps").alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    pairs = e.select(F.explode(F.expr("flatten(transform(ps, (a, i) -> transform(slice(ps, i + 2, size(ps)), b -> struct(a AS a, b AS b))))")).alias("x")).groupBy("x.a", "x.b").agg(F.count("*").alias("together")).where(f"together >= {least}")
    j = pairs.join(n.select(F.col("p").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("p").alias("b"), F.col("n").alias("nb")), "b")
    return j.select(F.col("a").alias("path_a"), F.col("b").alias("path_b"), "together", F.round(F.col("together") / F.least("na", "nb"), 6).alias("coupling"))
