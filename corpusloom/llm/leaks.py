"""Problem 9: documents that hold passages of held-out items, by a prefix-filtered set join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.tables import cut

WINDOW, SHINGLE = 13, 5
#: item shingles that may be broadcast: at most 16 bytes each, so 3 MB; beyond it Spark shuffles both sides
BROADCAST_ROWS = 200_000


def words(text: str = "text") -> Column:
    """The runs of letters and digits of the lower-cased text, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _runs(ws: str, k: int) -> Column:
    """Hash of the run of ``k`` words at each place; empty when there are fewer words."""
    return F.expr(f"CASE WHEN size({ws}) >= {k} THEN transform(sequence(0, size({ws}) - {k}), i -> xxhash64({', '.join(f'{ws}[i + {j}]' for j in range(k))})) ELSE array() END")


def item_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, win, run array<string>, h, off): for each item-sized window its words and, row by row, its shingles with their offsets."""
    w = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", words().alias("ws")).where(F.size("ws") >= window)
    w = w.select("item_id", F.posexplode(F.expr(f"transform(sequence(1, size(ws) - {window} + 1), i -> slice(ws, i, {window}))")).alias("win", "run"))
    return w.select("item_id", "win", "run", F.posexplode(_runs("run", shingle)).alias("off", "h"))


def leaked(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id) of the documents that hold ``window`` consecutive words of an item.

    A window is a set of ``window - shingle + 1`` shingles, all of which a document must hold, so its prefix is one
    shingle: the one that fewest documents of the whole corpus hold. Where a document holds it, the window must fit
    between the document's ends around that place (length and position), and is then compared word by word.

    Documents with one doc_id count once for each pair. Null ids and null or empty texts are no cases, nor are items
    with fewer than ``window`` words. Ties of rarity fall to the smaller hash. Empty tables give no rows; extra columns
    are ignored. A document's places of item shingles are the only rows shuffled; texts only of documents with a hit.
    """
    grams = cut(item_windows(items, window, shingle))
    keys = grams.select("h").distinct()
    n_keys = keys.count()
    base = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", words().alias("ws"))
    spots = base.select("doc_id", F.size("ws").alias("n"), F.posexplode(_runs("ws", shingle)).alias("at", "h"))
    spots = spots.join(F.broadcast(keys) if n_keys <= BROADCAST_ROWS else keys, "h")
    spots = cut(spots)  # used for the counts and for the join; holds only shingles that some item has
    # rarity over all documents; a shingle in a third of the corpus is counted map-side first
    held = spots.groupBy("h", "doc_id").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("one").alias("df"))
    prefix = grams.join(held, "h").groupBy("item_id", "win").agg(F.count("h").alias("n_held"), F.min(F.struct("df", "h", "off")).alias("r"), F.first("run").alias("run"))
    prefix = prefix.where(F.col("n_held") == window - shingle + 1)  # a window with a shingle that no document holds is in none
    small = prefix.select("item_id", "run", F.col("r.h").alias("h"), F.col("r.off").alias("off"))
    fits = (F.col("at") >= F.col("off")) & (F.col("at") - F.col("off") + window <= F.col("n"))
    cand = spots.join(F.broadcast(small) if n_keys <= BROADCAST_ROWS else small, "h").where(fits)
    cand = cand.groupBy("doc_id").agg(F.collect_set(F.struct("item_id", (F.col("at") - F.col("off")).alias("start"), "run")).alias("c"))  # bounded by one document's hits
    hit = base.join(cand, "doc_id").select("doc_id", F.expr(f"array_distinct(transform(filter(c, x -> slice(ws, x.start + 1, {window}) = x.run), x -> x.item_id))").alias("found"))
    return hit.select("doc_id", F.explode("found").alias("item_id")).distinct()


def leak_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, suite, n_docs): every item with the number of documents that hold a passage of it; 0 where none does."""
    n = leaked(docs, items).groupBy("item_id").agg(F.count("doc_id").alias("n_docs"))
    return items.where("item_id IS NOT NULL").select("item_id", "suite").join(n, "item_id", "left").select("item_id", "suite", F.coalesce("n_docs", F.lit(0).cast("long")).alias("n_docs"))


# The same in SQL: all 13-word runs of both sides, joined on their text.
_RUNS = """
{name} AS (
  SELECT {key}, array_to_string(list_slice(ws, i, i + 12), ' ') AS run
  FROM (SELECT {key}, ws, unnest(range(1, len(ws) - 11)) AS i
        FROM (SELECT {key}, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM {table} WHERE text IS NOT NULL AND {key} IS NOT NULL)
        WHERE len(ws) >= 13)
)"""
_BOTH = "WITH" + _RUNS.format(name="d", key="doc_id", table="documents") + "," + _RUNS.format(name="e", key="item_id", table="eval_items")
FOUND_SQL = _BOTH + " SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (run)"
REPORT_SQL = _BOTH + ", f AS (SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (run)) SELECT i.item_id, any_value(i.suite) AS suite, count(f.doc_id) AS n_docs FROM eval_items i LEFT JOIN f ON f.item_id = i.item_id GROUP BY i.item_id"
