"""Problem 8: exact byte-pair encoding in linear time, and decoding by an offset table."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# ---- fixed values: how the public vocabulary splits a text before it merges -----------------------------------
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# --------------------------------------------------------------------------------------------------------------
#: bytes of distinct pieces whose ids a worker keeps
MEMO_BYTES = 32 << 20


class Codec:
    """Encoder and decoder of one rank file (a line a token: base64 of its bytes, its rank; ranks are ids and merge order).

    The encoder walks a piece by longest matches, found for all places in one pass of an Aho-Corasick automaton. A token
    may follow another only if the merges could leave the two side by side (``fits``); else the next shorter token is tried,
    and when none is left the last token is taken back. Each place is given up at most once, so time is linear in the piece.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            words = {int(r): base64.b64decode(w) for w, r in map(bytes.split, f)}
        self.words = [words[k] for k in range(len(words))]
        self.size = [len(w) for w in self.words]
        rank = {w: k for k, w in enumerate(self.words)}
        #: shorter[t]: the longest token that is a proper prefix of t, or -1
        self.shorter = [next((rank[w[:n]] for n in range(len(w) - 1, 0, -1) if w[:n] in rank), -1) for w in self.words]
        #: how each token came to be: its two halves, or itself twice for a single byte
        self.left, self.right, self.joined = [], [], {}
        for t, w in enumerate(self.words):
            halves, a = (t, t), self.shorter[t]
            while a >= 0:
                b = rank.get(w[self.size[a] :])
                if b is not None and a < t and b < t and self.fits(a, b):
                    halves = (a, b)
                    self.joined[halves] = t
                    break
                a = self.shorter[a]
            self.left.append(halves[0])
            self.right.append(halves[1])
        self.machine = ahocorasick.Automaton()
        for t, w in enumerate(self.words):
            self.machine.add_word(w.decode("latin-1"), t)
        self.machine.make_automaton()
        self.offsets = np.concatenate([[0], np.cumsum(self.size)])
        self.bytes = b"".join(self.words)
        self.split = regex.compile(PIECES)
        self.memo: dict[str, list[int]] = {}
        self.kept = 0

    def fits(self, a: int, b: int) -> bool:
        """Whether merging leaves a and b apart: no merge across their border comes before the merges that made them."""
        bound = 1 << 40
        while True:
            if self.joined.get((a, b), bound) < bound:
                return False
            if a > b:  # undo the later merge first
                bound, a = a, self.right[a]
                if a == bound:
                    bound, b = b + 1, self.left[b]
                    if b + 1 == bound:
                        return True
            else:
                bound, b = b + 1, self.left[b]
                if b + 1 == bound:
                    bound, a = a, self.right[a]
                    if a == bound:
                        return True

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        longest = [-1] * len(piece)
        for end, t in self.machine.iter(piece.decode("latin-1")):
            longest[end - self.size[t] + 1] = t  # of one start, the longer match ends later
        size, shorter, fits = self.size, self.shorter, self.fits
        open_, out, at, n = bytearray(b"\1") * (len(piece) + 1), [], 0, len(piece)
        t = longest[0] if n else -1
        while at < n:
            end = at + size[t]
            if open_[end] and (not out or fits(out[-1], t)):
                out.append(t)
                at = end
                t = longest[at] if at < n else -1
                continue
            t = shorter[t]
            if t < 0:
                open_[at] = 0
                t = out.pop()
                at -= size[t]
                # the token taken back ends at a closed place, so the loop goes on with a shorter one
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a text, without special tokens; their strings in the text are ordinary text."""
        out: list[int] = []
        memo = self.memo
        for p in self.split.findall(text):
            ids = memo.get(p)
            if ids is None:
                ids = self.merge(p.encode("utf-8"))
                if len(p) <= 64:
                    self.kept += 120 + len(p)
                    if self.kept > MEMO_BYTES:
                        memo.clear()
                        self.kept = 120 + len(p)
                    memo[p] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: each id's bytes stand between two neighbours of the offset table."""
        o = self.offsets
        return b"".join(self.bytes[o[t] : o[t + 1]] for t in ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): the token ids of every text, whole, one row for each row of ``docs``.

    Null, empty: an empty list. Blank texts are encoded as they stand. Extra columns are ignored. No shuffle on a scan of
    enough parts; ``vocabulary`` is a path that every executor can read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(vocabulary)
        for b in batches:
            yield pd.DataFrame({key: b[key], "ids": [c.encode(t) if t else [] for t in b[text]]})

    from corpusloom.sources.tables import spread

    kind = docs.schema[key].dataType.simpleString()
    return spread(docs.select(key, text)).mapInPandas(run, f"`{key}` {kind}, ids array<int>")


def decode(encoded: DataFrame, key: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text) of (key, ids). Null ids give a null text, an empty list an empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(vocabulary)
        for b in batches:
            yield pd.DataFrame({key: b[key], "text": [None if v is None else c.decode(v) for v in b["ids"]]})

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "ids").mapInPandas(run, f"`{key}` {kind}, text string")


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(source, n_docs, n_tokens, n_exact): per source, the tokens and the texts that come back unchanged; null counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(vocabulary)
        for b in batches:
            ids = [c.encode(t) if t else [] for t in b["text"]]
            yield pd.DataFrame({"source": b["source"], "n": [len(x) for x in ids], "same": [c.decode(x) == (t or "") for x, t in zip(ids, b["text"])]})

    from corpusloom.sources.tables import spread

    one = spread(docs.select("source", "text")).mapInPandas(run, "source string, n long, same boolean")
    return one.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"), F.sum(F.col("same").cast("long")).alias("n_exact"))
