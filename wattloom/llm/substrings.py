"""Substring dedup: words inside passages of `LENGTH` words or more that occur more than once, in one text or in several, are removed.

Seeds: of the hashes of `SEED` consecutive words each window of `LENGTH` words takes the smallest, the leftmost of equals, as its anchor. Windows of equal words
have equal anchors, so passages meet at their anchors; windows of one anchor follow each other, and an anchor's stretch reaches from the first to the last.

Extension: anchors with the same seed meet. Stretches that are equal from end to end are repeats in whole, all at once. Where stretches of one seed
differ, one of each kind goes back to its text and is extended window by window, so that each passage is kept at its greatest length, whatever
pair of texts it comes from. Removed words are the union of the repeats, judged on the input.

Each partition of texts settles what repeats inside it before anything is moved, and sends one row of each kind on; texts that occur twice as a whole are
known from counts of their hashes. No pairs of texts are formed. Texts move only where a repeat was found.

Defined results: null and empty texts have no words and the digest of an empty string. Texts of fewer than `LENGTH` words lose nothing. Repeated rows are
occurrences of their own, so all of their words go if they have enough. Input columns named like a result are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wattloom.llm.common import BROADCAST_ROWS, keeping, settle
from wattloom.llm.words import NO_SPACE, Sums, grams, mix, slices, text_of, word_hashes
from wattloom.operators.skew import salted_join

LENGTH, SEED = 35, 8
SPAN = LENGTH - SEED + 1  # seeds of a window
RESULTS = ("n_words long", "n_removed long", "kept_sha256 string")
ANCHORS = "h long, cls long, t long, lo int, hi int, many boolean"
_ANCHORS = pa.schema([("h", pa.int64()), ("cls", pa.int64()), ("t", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("many", pa.bool_())])
_WINDOWS = pa.schema([("w", pa.int64()), ("v", pa.int32()), ("t", pa.int64()), ("at", pa.int32()), ("many", pa.bool_())])


class Hashed:
    """Word hashes of several texts, with sums that give the hash of any stretch."""

    def __init__(self, texts: list):
        self.h, self.first = word_hashes(texts, NO_SPACE)
        self.sums = Sums(self.h)
        self.text = text_of(self.first)
        g, at = grams(self.h, self.first, SEED)
        self.seeds = np.full(len(self.h), np.iinfo(np.uint64).max, np.uint64)
        self.seeds[at] = g

    def stretch(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.sums.between(begin, end) + (end - begin).astype(np.uint64))

    def windows(self) -> np.ndarray:
        """First words of all windows."""
        m = len(self.h) - LENGTH + 1
        return np.flatnonzero(self.text[:m] == self.text[LENGTH - 1 :]) if m > 0 else np.zeros(0, np.int64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors, and the first and last window of each."""
        w = self.windows()
        if not len(w):
            return w, w, w
        least = np.arange(len(self.h))

        def better(a, b):
            return np.where(self.seeds[b] < self.seeds[a], b, a)

        step = 1
        while 2 * step <= SPAN:
            least = better(least[:-step], least[step:])
            step *= 2
        least = better(least[: len(least) - (SPAN - step)], least[SPAN - step :])
        own = least[w]
        begin = np.flatnonzero((np.diff(own, prepend=-1) != 0) | (np.diff(w, prepend=-2) != 1))
        end = np.append(begin[1:], len(w)) - 1
        return own[begin], w[begin], w[end]


def _settled(first: np.ndarray, second: np.ndarray):
    """Of rows with two keys: whether a row's keys come again, and the place of one row of each."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    group = np.cumsum(new) - 1
    many = np.empty(len(a), bool)
    many[order] = (np.bincount(group) > 1)[group] if len(a) else False
    return many, order[new]


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _find_anchors(batches):
    """Rows to meet others, one for each kind of a partition; repeats inside the partition come with no seed, and are settled."""
    had: set[int] = set()
    parts = []
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        fresh = []
        for i, k in enumerate(keys):
            if texts[i] and k not in had:
                had.add(k)
                fresh.append(i)
        keys, texts = [keys[i] for i in fresh], [texts[i] for i in fresh]
        for a, b in slices(texts):
            x = Hashed(texts[a:b])
            at, low, high = x.anchors()
            if len(at):
                own = x.text[at]
                cls = mix(x.stretch(low, high + LENGTH) + (at - low).astype(np.uint64))
                parts.append((x.seeds[at].view(np.int64), cls.view(np.int64), np.array(keys[a:b], np.int64)[own], (low - x.first[own]).astype(np.int32), (high - x.first[own]).astype(np.int32)))
    if parts:
        h, cls, t, low, high = (np.concatenate(c) for c in zip(*parts))
        many, one = _settled(h, cls)
        yield _batch([h[one], cls[one], t[one], low[one], high[one], many[one]], _ANCHORS)
        known = np.flatnonzero(many)
        if len(known):
            yield _batch([[None] * len(known), [None] * len(known), t[known], low[known], high[known], many[known]], _ANCHORS)


def _find_windows(batches):
    """Windows of the stretches that differ, one for each kind of a partition; repeats inside the partition come without a hash."""
    parts = []
    for batch in batches:
        keys, texts, ranges = (batch.column(i).to_pylist() for i in range(3))
        for a, b in slices(texts):
            x = Hashed(texts[a:b])
            for i in range(a, b):
                base = int(x.first[i - a])
                w = np.unique(np.concatenate([np.arange(r["lo"], r["hi"] + 1) for r in ranges[i]])) + base
                v = mix(x.seeds[w] + np.uint64(3) * x.seeds[w + SPAN - 1]).view(np.int64).astype(np.int32)
                parts.append((x.stretch(w, w + LENGTH).view(np.int64), v, np.full(len(w), keys[i], np.int64), (w - base).astype(np.int32)))
    if parts:
        w, v, t, at = (np.concatenate(c) for c in zip(*parts))
        many, one = _settled(w, v)
        yield _batch([w[one], v[one], t[one], at[one], many[one]], _WINDOWS)
        known = np.flatnonzero(many)
        if len(known):
            yield _batch([[None] * len(known), [None] * len(known), t[known], at[known], many[known]], _WINDOWS)


def _pruned(docs: DataFrame, ranges: DataFrame, how: str) -> DataFrame:
    """Documents joined with the ranges of their text; those without any stay where they are, if the keys are few enough to be sent everywhere."""
    keys = ranges.select("t")
    if keys.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        # copies of one text have one key; their own numbers spread them
        return salted_join(docs.withColumn("_row", F.monotonically_increasing_id()), ranges, ["t"], how).drop("_row")
    some = docs.join(F.broadcast(keys), "t", "left_semi").join(ranges, "t")
    if how == "inner":
        return some
    rest = docs.join(F.broadcast(keys), "t", "left_anti")
    return some.unionByName(rest.withColumn("ranges", F.lit(None).cast(ranges.schema["ranges"].dataType)))


def _merged(rows: DataFrame) -> DataFrame:
    """(t, ranges) from (t, lo, hi): what one text has."""
    return rows.groupBy("t").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(t, ranges): the word ranges (both ends inclusive) of each text that repeats somewhere, from (t, text)."""
    anchors = settle(docs.select("t", "text").mapInArrow(_find_anchors, ANCHORS), "repeat-anchors")
    weight = F.when(F.col("many"), F.lit(2)).otherwise(F.lit(1))
    # an anchor may stand in very many texts: its kinds are counted with partial sums, and only single rows of them meet
    seeds = anchors.filter("h is not null")
    kinds = seeds.groupBy("h", "cls").agg(F.sum(weight).alias("_kind"), F.min(F.struct("t", "lo", "hi")).alias("_first"))
    kinds = settle(kinds, "repeat-kinds")
    both = salted_join(kinds, kinds.groupBy("h").agg(F.sum("_kind").alias("_seed")).filter("_seed > 1"), ["h"])
    differs = both.filter(F.col("_seed") > F.col("_kind")).select("_first.*")
    again = salted_join(seeds, kinds.filter("_kind > 1").select("h", "cls"), ["h", "cls"], "left_semi").select("t", "lo", "hi")
    met = settle(differs.withColumn("differs", F.lit(True)).unionByName(again.withColumn("differs", F.lit(False))), "repeat-met")

    differing = settle(_merged(met.filter("differs")), "repeat-differing")
    texts = _pruned(docs.select("t", "text"), differing, "inner").dropDuplicates(["t"]).select("t", "text", "ranges")
    windows = settle(texts.mapInArrow(_find_windows, "w long, v int, t long, at int, many boolean"), "repeat-windows")
    several = windows.filter("w is not null").groupBy("w", "v").agg(F.sum(weight).alias("_n")).filter("_n > 1").select("w", "v")
    again = salted_join(windows.filter("w is not null"), several, ["w", "v"], "left_semi")
    again = again.select("t", "at").union(windows.filter("w is null").select("t", "at")).select("t", F.col("at").alias("lo"), F.col("at").alias("hi"))

    whole = anchors.filter("h is null").select("t", "lo", "hi").union(met.filter("not differs").select("t", "lo", "hi"))
    twice = docs.groupBy("t").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("t", F.lit(0).alias("lo"), F.lit(2**31 - LENGTH - 1).alias("hi"))
    every = whole.union(again).select("t", "lo", (F.col("hi") + LENGTH - 1).alias("hi"))
    return settle(_merged(every.union(twice)), "repeat-ranges")


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Adds `n_words`, `n_removed`, `kept_sha256` (and `kept_text`) to documents, and drops `text`."""
    return keeping(docs, ["text"], lambda kept: _dedup(kept, with_text), ["text"])


def _dedup(kept: DataFrame, with_text: bool) -> DataFrame:
    keyed = kept.withColumn("t", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    joined = _pruned(keyed, repeated_ranges(keyed), "left")
    others = [c for c in kept.columns if c != "text"]
    made = StructType.fromDDL(", ".join([*RESULTS, *["kept_text string"] * with_text]))
    schema = StructType([f for f in kept.schema.fields if f.name != "text"] + made.fields)

    def cut(batches):
        for batch in batches:
            n, gone, digest, left = [], [], [], []
            for text, ranges in zip(batch.column(len(others)).to_pylist(), batch.column(len(others) + 1).to_pylist()):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                if ranges and len(words) >= LENGTH:
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, [r["lo"] for r in ranges], 1)
                    np.add.at(change, [min(r["hi"] + 1, len(words)) for r in ranges], -1)
                    stays = np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()
                    rest = [words[i] for i in stays]
                else:
                    rest = words
                joined = b" ".join(rest)
                n.append(len(words))
                gone.append(len(words) - len(rest))
                digest.append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    left.append(joined.decode("utf-8", "surrogatepass"))
            made = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), *([pa.array(left, pa.string())] if with_text else [])]
            names = [*others, *[r.split()[0] for r in RESULTS], *(["kept_text"] if with_text else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *made], names=names)

    return joined.select(*[F.col(f"`{c}`") for c in others], "text", "ranges").mapInArrow(cut, schema)
