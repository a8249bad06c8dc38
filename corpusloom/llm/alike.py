"""Problem 7: chunks that hold the same text with edits, by prefix buckets and bit-sliced comparison."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.tables import cut

WORDS, SHINGLE, SIMILARITY = 20, 3, 0.7
#: bits of a text's parity map; distances are compared on it before the sets are
BITS = 512
#: cells of the table of shingle frequencies, and of the one that tells which shingles of prefixes may be shared; their sizes
#: are fixed whatever the corpus holds: when broadcast a byte and a bit a cell (2 MB each). A page of cells is a row of the sum
CELLS, SHARED_CELLS, PAGES = 1 << 21, 1 << 24, 128
#: shingles that may be broadcast, 8 bytes each; more are joined by a shuffle
BROADCAST_ROWS = 400_000
#: members of a bucket that are compared in one task; a larger bucket is split into pairs of tiles
TILE = 2048


def shingle_sets(text: str, least: int = WORDS, k: int = SHINGLE) -> Column:
    """Hashes of the distinct runs of ``k`` words (a-z, 0-9, _) of the lower-cased text; null with fewer than ``least`` words."""
    ws = F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda w: w != "")
    return F.transform(F.array(ws), lambda w: F.when(F.size(w) >= least, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[w[i + j] for j in range(k)])))))[0]


# ---- bit planes -----------------------------------------------------------------------------------------------
def parity_map(shingles: np.ndarray, bits: int = BITS) -> np.ndarray:
    """A bit for each cell: how often shingles fall into it, odd or even. Two maps differ in at most as many bits as their sets differ in members."""
    h = shingles.astype(np.uint64)
    cell = ((h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=bits) & 1).astype(np.uint8))


def planes(maps: np.ndarray) -> np.ndarray:
    """Vertical store: of n maps (n a multiple of 64) the plane of each bit, as words of 64 lanes; shape (bits, n / 64)."""
    return np.ascontiguousarray(np.packbits(np.unpackbits(maps, axis=1).T, axis=1)).view(np.uint64)


def within(left: np.ndarray, right: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Which pairs of rows of two (n, bits / 8) arrays differ in at most ``radius`` bits.

    64 pairs share a word. Of each eight planes the differences are added by carry-save adders into bit-sliced counters;
    then every lane's counter is compared with its radius bit by bit, and words whose lanes are all beyond it are left.
    """
    n = len(left)
    pad = -n % 64
    if pad:
        left, right = np.pad(left, ((0, pad), (0, 0))), np.pad(right, ((0, pad), (0, 0)))
        radius = np.pad(radius, (0, pad), constant_values=-1)
    bits = left.shape[1] * 8
    width = bits.bit_length()
    diff = planes(left ^ right)
    r = np.minimum(np.maximum(radius, 0), bits).astype(np.int64)
    bound = [np.packbits(((r >> k) & 1).astype(np.uint8)).view(np.uint64) for k in range(width)]
    none = np.packbits((radius < 0).astype(np.uint8)).view(np.uint64)
    alive = np.arange(diff.shape[1])
    total = [np.zeros(len(alive), dtype=np.uint64) for _ in range(width)]
    out = np.zeros(len(alive), dtype=np.uint64)

    def add(a, b, c):  # carry-save: three words of one weight give a sum and a carry
        u = a ^ b
        return u ^ c, (a & b) | (u & c)

    for p in range(0, bits, 8):
        d = diff[p : p + 8][:, alive] if len(alive) < diff.shape[1] else diff[p : p + 8]
        total[0], t1 = add(total[0], d[0], d[1])
        total[0], t2 = add(total[0], d[2], d[3])
        total[1], f1 = add(total[1], t1, t2)
        total[0], t1 = add(total[0], d[4], d[5])
        total[0], t2 = add(total[0], d[6], d[7])
        total[1], f2 = add(total[1], t1, t2)
        total[2], carry = add(total[2], f1, f2)
        for k in range(3, width):
            total[k], carry = total[k] ^ carry, total[k] & carry
        if (p + 8) % 64 and p + 8 < bits:
            continue
        over, same = np.zeros(len(alive), dtype=np.uint64), np.full(len(alive), ~np.uint64(0))
        for k in range(width - 1, -1, -1):
            b = bound[k][alive]
            over |= same & total[k] & ~b
            same &= ~(total[k] ^ b)
        over |= none[alive]
        if p + 8 == bits:
            out[alive] = ~over
            break
        keep = over != ~np.uint64(0)
        if not keep.all():
            alive = alive[keep]
            total = [t[keep] for t in total]
        if not len(alive):
            break
    return np.unpackbits(out.view(np.uint8))[:n].astype(bool)


def _radius(na: np.ndarray, nb: np.ndarray, similarity: float) -> np.ndarray:
    """Most members in which two sets of these sizes may differ at this similarity; -1 where their sizes alone rule it out."""
    lo, hi = np.minimum(na, nb), np.maximum(na, nb)
    r = np.floor((na + nb) * (1 - similarity) / (1 + similarity) + 1e-9).astype(np.int64)
    return np.where(lo < similarity * hi - 1e-9, -1, r)


def bucket_pairs(classes: np.ndarray, sizes: np.ndarray, maps: np.ndarray, side: np.ndarray | None, similarity: float, at_once: int = 1 << 16) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members of one bucket (or of two tiles, by ``side``) that may be alike; only sizes that allow it are compared, ``at_once`` pairs at a time."""
    order = np.argsort(sizes, kind="stable")
    classes, sizes, maps = classes[order], sizes[order], maps[order]
    side = side[order] if side is not None else None
    # member i is compared with those after it whose size is near enough
    last = np.searchsorted(sizes, np.floor(sizes / similarity + 1e-9), side="right")
    count = last - np.arange(len(sizes)) - 1
    out, i = [], 0
    while i < len(sizes):
        j, load = i, 0
        while j < len(sizes) and (j == i or load + count[j] <= at_once):
            load += count[j]
            j += 1
        n = count[i:j]
        a = np.repeat(np.arange(i, j), n)
        b = a + 1 + (np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n))
        if side is not None:
            m = side[a] != side[b]
            a, b = a[m], b[m]
        if len(a):
            ok = within(maps[a], maps[b], _radius(sizes[a], sizes[b], similarity))
            if ok.any():
                out.append((classes[a[ok]], classes[b[ok]]))
        i = j
    return out


# ---- plan -----------------------------------------------------------------------------------------------------
def _cell(h: np.ndarray, cells: int) -> np.ndarray:
    u = h.view(np.uint64)
    if cells != CELLS:  # another hash than that of the frequencies
        u = (u ^ (u >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (u >> np.uint64(64 - cells.bit_length() + 1)).astype(np.int64)


def _count(column: str, cells: int, most: int | None):
    """Counts of a partition's hashes by cell, as compressed pages; with ``most`` they stop there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind = np.uint8 if most else np.uint32
        have = np.zeros(cells, dtype=kind)
        for b in batches:
            if len(b):
                at, n = np.unique(_cell(np.concatenate([np.asarray(x, dtype=np.int64) for x in b[column]]), cells), return_counts=True)
                have[at] = np.minimum(have[at] + n, most) if most else have[at] + n
        pages = have.reshape(PAGES, -1)
        used = np.nonzero(pages.any(axis=1))[0]
        yield pd.DataFrame({"page": used.astype(np.int32), "cells": [zlib.compress(pages[k].tobytes(), 1) for k in used]})

    return run


def _table(df: DataFrame, column: str, cells: int, most: int | None, finish) -> bytes:
    """One table of all partitions' counts: pages are summed where they meet, ``finish`` makes a page's bytes, and their fixed number comes to the driver."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind = np.uint8 if most else np.uint32
        pages: dict[int, np.ndarray] = {}
        for b in batches:
            for page, raw in zip(b["page"], b["cells"]):
                x = np.frombuffer(zlib.decompress(raw), dtype=kind)
                have = pages.get(page)
                pages[page] = x if have is None else np.minimum(have + x, most).astype(kind) if most else have + x
        yield pd.DataFrame({"page": list(pages), "cells": [finish(x).tobytes() for x in pages.values()]})

    size = len(finish(np.zeros(cells // PAGES, dtype=np.uint8 if most else np.uint32)).tobytes())
    out = bytearray(size * PAGES)
    for r in df.select(column).mapInPandas(_count(column, cells, most), "page int, cells binary").repartition("page").mapInPandas(add, "page int, cells binary").collect():
        out[r["page"] * size : (r["page"] + 1) * size] = r["cells"]
    return bytes(out)


def _log(counts: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.ceil(np.log2(np.maximum(counts, 1)) * 8)).astype(np.uint8)


def _twice(counts: np.ndarray) -> np.ndarray:
    return np.packbits(counts >= 2)


def _prefixes(table, similarity: float, tile: int):
    """For each set its parity map and the shingles of its prefix, rarest first by the broadcast table; and whether a shingle may fill more than a tile.

    Copies in one partition come out once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log = np.frombuffer(table.value, dtype=np.uint8)
        seen: set[int] = set()
        for b in batches:
            rows = []
            for c, sh in zip(b["class"], b["sh"]):
                if c in seen:
                    continue
                seen.add(c)
                sh = np.asarray(sh, dtype=np.int64)
                est = log[_cell(sh, CELLS)]
                order = np.lexsort((sh, est))[: len(sh) - int(np.ceil(similarity * len(sh) - 1e-9)) + 1]
                rows.append((c, len(sh), parity_map(sh).tobytes(), sh[order], int((est[order] >= np.log2(tile) * 8).sum())))
            yield pd.DataFrame(rows, columns=["class", "n", "map", "prefix", "n_hot"])

    return run


def _spots(table):
    """(class, h, spot, hot) of the shingles of prefixes that another prefix may have: those alone in their cell end here. The last ``n_hot`` of a prefix are hot.

    ``spot`` holds the size of the set and the shingle's place in the prefix, in 32 bits each.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.frombuffer(table.value, dtype=np.uint8)
        for b in batches:
            if not len(b):
                continue
            n = np.array([len(x) for x in b["prefix"]])
            spot = np.concatenate([(size << 32) + np.arange(k) for size, k in zip(b["n"].astype(np.int64), n)])
            h = np.concatenate([np.asarray(x, dtype=np.int64) for x in b["prefix"]])
            hot = np.concatenate([np.arange(k) >= k - m for k, m in zip(n, b["n_hot"])])
            cell = _cell(h, SHARED_CELLS)
            keep = (bits[cell >> 3] >> (7 - (cell & 7)) & 1).astype(bool)
            yield pd.DataFrame({"class": np.repeat(b["class"].to_numpy(), n)[keep], "h": h[keep], "spot": spot[keep], "hot": hot[keep]})

    return run


def _able(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets may be alike, if a shingle at these spots is the first they share: by their sizes and by what is left behind it."""
    na, nb = a >> 32, b >> 32
    left = np.minimum(na - (a & 0xFFFFFFFF), nb - (b & 0xFFFFFFFF))
    return (np.minimum(na, nb) >= similarity * np.maximum(na, nb) - 1e-9) & (left * (1 + similarity) >= similarity * (na + nb) - 1e-9)


def _buckets(similarity: float):
    """(h, m) of rows in order of h: the classes that have the shingle in their prefixes, without those for which no other is near enough.

    Two sets that are alike pass at the first shingle they share, so each such pair stays together in one bucket at least.
    """

    def lists(h: np.ndarray, c: np.ndarray, spot: np.ndarray) -> pd.DataFrame:
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        n = np.diff(np.r_[start, len(h)])
        i = start[n == 2]
        i = i[(c[i] != c[i + 1]) & _able(spot[i], spot[i + 1], similarity)]
        keys, found = [h[i]], list(np.sort(np.stack([c[i], c[i + 1]], axis=1), axis=1))
        for k, size in zip(start[n > 2], n[n > 2]):
            m, first = np.unique(c[k : k + size], return_index=True)
            s = spot[k : k + size][first]
            ok = _able(s[:, None], s[None, :], similarity)
            np.fill_diagonal(ok, False)
            m = m[ok.any(axis=1)]
            if len(m):
                keys.append(h[k : k + 1])
                found.append(m)
        return pd.DataFrame({"h": np.concatenate(keys), "m": pd.Series(found, dtype=object)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []  # the rows of the last shingle, which may go on
        for b in batches:
            if not len(b):
                continue
            if rest and b["h"].iloc[-1] == rest[0]["h"].iloc[-1]:
                rest.append(b)
                continue
            b = pd.concat([*rest, b])
            h = b["h"].to_numpy()
            end = int(np.searchsorted(h, h[-1]))
            rest = [b.iloc[end:]]
            if end:
                yield lists(h[:end], b["class"].to_numpy()[:end], b["spot"].to_numpy()[:end])
        if rest:
            b = pd.concat(rest)
            yield lists(b["h"].to_numpy(), b["class"].to_numpy(), b["spot"].to_numpy())

    return run


def _compare(similarity: float, at_once: int = 1 << 16):
    """Pairs within the radius of all buckets of a partition; those of small buckets are gathered so that the bit planes are full."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number: dict[int, int] = {}  # of a class in the store of the pairs gathered
        store: list[tuple[int, bytes]] = []
        left, right, load = [], [], 0

        def flush() -> pd.DataFrame:
            pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1)  # buckets share many pairs
            n = np.array([x for x, _ in store], dtype=np.int64)
            maps = np.frombuffer(b"".join(x for _, x in store), dtype=np.uint8).reshape(len(n), -1)
            names = np.fromiter(number, dtype=np.int64, count=len(number))
            ok = within(maps[pairs[0]], maps[pairs[1]], _radius(n[pairs[0]], n[pairs[1]], similarity))
            x, y = names[pairs[0][ok]], names[pairs[1][ok]]
            for z in (number, store, left, right):
                z.clear()
            return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})

        for b in batches:
            for two, members in zip(b["two"], b["members"]):
                if len(members) > 64:
                    c = np.array([m["class"] for m in members], dtype=np.int64)
                    n = np.array([m["n"] for m in members], dtype=np.int64)
                    maps = np.frombuffer(b"".join(m["map"] for m in members), dtype=np.uint8).reshape(len(c), -1)
                    side = np.array([m["side"] for m in members]) if two else None
                    for x, y in bucket_pairs(c, n, maps, side, similarity):
                        yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})
                    continue
                at = []
                for m in members:
                    k = number.setdefault(m["class"], len(number))
                    if k == len(store):
                        store.append((m["n"], m["map"]))
                    at.append(k)
                i, j = np.triu_indices(len(at), 1)
                at = np.array(at)
                x, y = at[i], at[j]
                if two:
                    side = np.array([m["side"] for m in members])
                    keep = side[i] != side[j]
                    x, y = x[keep], y[keep]
                left.append(np.minimum(x, y))
                right.append(np.maximum(x, y))
                load += len(x)
                if load >= at_once:
                    yield flush()
                    load = 0
        if left:
            yield flush()

    return run


def alike(chunks: DataFrame, similarity: float = SIMILARITY, least: int = WORDS, k: int = SHINGLE, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (id, class) has every chunk with enough words; links (a, b), a < b, every pair of classes that are alike.

    A class is a set of shingles; chunks with the same set are copies and compared once. Two sets of Jaccard similarity
    ``similarity`` or more share a shingle of their prefixes, which are taken in one order for all: by a table of
    frequencies over the whole corpus, rarest first, then by hash. Of a bucket (a shingle of prefixes) those members are left
    that no other is near enough to by sizes and places, if this is the first shingle both have. The others are compared by
    bit-sliced distances of parity maps, which never exceed the true difference of the sets, and pairs within the radius
    are verified on the sets. So no pair is lost, whatever the table's collisions; it only orders.
    A bucket of more than ``tile`` members is split into tiles and each pair of tiles is a group of its own.

    Repeated ids count by their latest delivery (null times are oldest, ties fall to the greater set hash). Null ids, null,
    empty and short texts have no class. Empty tables give no rows; extra columns are ignored.
    """
    spark = chunks.sparkSession
    at = F.coalesce(F.col("ingested_at").cast("timestamp"), F.lit("0001-01-01").cast("timestamp"))
    rows = chunks.where("id IS NOT NULL").select("id", at.alias("at"), F.sort_array(shingle_sets("text", least, k)).alias("sh"))
    rows = rows.withColumn("class", F.when(F.col("sh").isNotNull(), F.xxhash64("sh")))
    rows = cut(rows)
    members = rows.groupBy("id").agg(F.max(F.struct("at", "class")).alias("r")).select("id", F.col("r.class").alias("class")).where("class IS NOT NULL")
    sets = rows.where("class IS NOT NULL").select("class", "sh")
    table = spark.sparkContext.broadcast(_table(sets, "sh", CELLS, None, _log))
    one = sets.mapInPandas(_prefixes(table, similarity, tile), "class long, n int, map binary, prefix array<long>, n_hot int")
    # prefixes are cheaper to compute again from the sets than to write
    shared_cells = spark.sparkContext.broadcast(_table(one, "prefix", SHARED_CELLS, 2, _twice))
    spots = one.select("class", "n", "prefix", "n_hot").mapInPandas(_spots(shared_cells), "class long, h long, spot long, hot boolean")
    hot = None
    if max(table.value) >= np.log2(tile) * 8:
        # exact counts only of the shingles that may fill more than a tile
        hot = cut(spots.where("hot").groupBy("h", "class").agg(F.lit(1).alias("x")).groupBy("h").agg(F.count("x").alias("m")).where(F.col("m") > tile).select("h", F.ceil(F.col("m") / tile).cast("int").alias("tiles")))
        n_hot = hot.count()
        hot = (F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot) if n_hot else None
    # buckets of all other shingles are made where their rows meet; nearly all shingles have one class and end there
    cool = (spots if hot is None else spots.join(hot.select("h"), "h", "left_anti")).select("h", "class", "spot")
    lists = cool.repartition("h").sortWithinPartitions("h").mapInPandas(_buckets(similarity), "h long, m array<long>")
    # texts that are alike share many shingles, so most buckets have the members of another
    same = lists.groupBy("m").agg(F.min(F.xxhash64("h")).alias("g"))
    once = same.select("g", F.lit(False).alias("two"), F.explode("m").alias("class"), F.lit(0).alias("side"))
    if hot is not None:
        tiled = spots.where("hot").join(hot, "h").select("h", "tiles", "class", F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int").alias("t")).distinct()
        tiled = tiled.select("h", "class", "t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("u"))
        tiled = tiled.select(F.xxhash64("h", F.least("t", "u"), F.greatest("t", "u")).alias("g"), (F.col("t") != F.col("u")).alias("two"), "class", F.when(F.col("t") < F.col("u"), 0).otherwise(1).alias("side"))
        # a bucket has two tiles at most
        same = tiled.groupBy("g", "two").agg(F.sort_array(F.collect_set(F.struct("class", "side"))).alias("m")).where("size(m) > 1").groupBy("two", "m").agg(F.min("g").alias("g"))
        once = once.unionByName(same.select("g", "two", F.explode("m").alias("x")).select("g", "two", "x.class", "x.side"))
    maps = one.select("class", "n", "map").dropDuplicates(["class"])
    full = once.join(maps, "class").groupBy("g", "two").agg(F.collect_list(F.struct("class", "n", "map", "side")).alias("members"))
    pairs = cut(full.mapInPandas(_compare(similarity), "a long, b long").distinct())
    needed = cut(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct())
    # sets of the candidates only; both sides of the join read one shuffle of them
    few = sets.join(F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed, "class", "left_semi").dropDuplicates(["class"])
    x, y = few.select(F.col("class").alias("a"), F.col("sh").alias("sa")), few.select(F.col("class").alias("b"), F.col("sh").alias("sb"))
    inter = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - inter
    links = pairs.join(x, "a").join(y, "b").where(inter * 1000 >= union * int(round(similarity * 1000))).select("a", "b")
    return members, links


def alike_pairs(chunks: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of all pairs of chunks whose sets are alike, pairs of copies included (see ``alike``)."""
    members, links = alike(chunks, similarity)
    members, links = cut(members), cut(links)
    across = links.join(members.select(F.col("class").alias("a"), F.col("id").alias("x")), "a").join(members.select(F.col("class").alias("b"), F.col("id").alias("y")), "b")
    copies = members.select("class", F.col("id").alias("x")).join(members.select("class", F.col("id").alias("y")), "class").where("x < y")
    return across.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).unionByName(copies.select(F.col("x").alias("id_a"), F.col("y").alias("id_b")))


def alike_groups(chunks: DataFrame, similarity: float = SIMILARITY, rounds: int = 30) -> DataFrame:
    """(id, class_id, n_copies, n_links, group_id): each chunk with enough words once.

    class_id is the smallest id of its copies, n_links the number of other classes alike to its own, group_id the smallest
    class id connected to it by links. Components shrink by joining every class to the smallest label around it until
    nothing changes; should ``rounds`` not do, it raises rather than return part of the result.
    """
    members, links = alike(chunks, similarity)
    members, links = cut(members), cut(links)
    classes = members.groupBy("class").agg(F.min("id").alias("class_id"), F.count("*").alias("n_copies"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg(F.count("*").alias("n_links")).withColumnRenamed("a", "class")
    names = classes.select("class", "class_id")
    edges = cut(both.join(names.select(F.col("class").alias("a"), F.col("class_id").alias("x")), "a").join(names.select(F.col("class").alias("b"), F.col("class_id").alias("y")), "b").select("x", "y"))
    label = cut(edges.select(F.col("x").alias("v"), F.col("x").alias("l")).distinct())
    for _ in range(rounds):
        near = edges.join(label.select(F.col("v").alias("y"), "l"), "y").select(F.col("x").alias("v"), "l")
        low = near.unionByName(label).groupBy("v").agg(F.min("l").alias("l"))
        # jump: the label's own label, so long chains halve
        new = cut(low.join(low.select(F.col("v").alias("l"), F.col("l").alias("m")), "l", "left").select("v", F.least("l", F.coalesce("m", "l")).alias("l")))
        changed = new.join(label.withColumnRenamed("l", "old"), "v").where("l <> old").limit(1).count()
        label = new
        if not changed:
            break
    else:
        raise RuntimeError("groups did not settle; raise rounds")
    out = members.join(classes, "class").join(degree, "class", "left").join(label.select(F.col("v").alias("class_id"), "l"), "class_id", "left")
    return out.select("id", "class_id", "n_copies", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("l", "class_id").alias("group_id"))
