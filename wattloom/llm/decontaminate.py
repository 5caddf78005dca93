"""Benchmark decontamination: rare n-gram seeds join training passages to test items, Smith-Waterman scores the alignment.

Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. All n-grams of the items are counted over the whole corpus; an
item's seeds are those not much more frequent than its rarer quarter, so that an item that leaked often still has seeds. Where a text shares
seeds with an item on nearby diagonals, the stretch around them is aligned with the item word by word (match 1, mismatch and gap -1). The score is the
best local alignment over the item's words; at `THRESHOLD` or more the text holds the item, be it exact, edited or paraphrased.

One seed is enough for an alignment, since edits all over a passage may leave no more. An item of one or two words is its own seed. Items are taken in blocks of `ITEMS`: the index of
one block is broadcast, meets all texts in one pass, writes the best hit of every text that has one under a digest of the text, and is taken back before the next block comes. So
what is broadcast and kept is bounded however many items there are, and texts do not move.

Defined results: null and empty texts, and texts without a hit, are clean with score 0 and no item. Items without a word are not searched.
Equal scores go to the smaller item_id. Repeated rows are judged each; repeated items count once by id and text. Empty tables: all clean.
Input columns named like a result are replaced; others are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import keeping, settle, small_join
from wattloom.llm.words import ALNUM, grams, slices, text_of, word_hashes

N = 3
ITEMS = 20_000
THRESHOLD = 0.4
TABLE_BITS = 22


def align(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of an item with each row of `windows` (word hashes, zero beyond the end): score, first and last matched place.

    Rows advance together; a gap along the window is a running maximum. The first place travels with the score.
    """
    n, w = windows.shape
    steps = np.arange(w + 1)
    score = np.zeros((n, w + 1), np.int32)
    start = np.tile(steps, (n, 1))
    best, first, last = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    every = np.arange(n)
    for a in item:
        step = np.where(windows == a, 1, -1).astype(np.int32)
        diagonal, above = score[:, :-1] + step, score[:, 1:] - 1
        now, begin = np.zeros_like(score), np.tile(steps, (n, 1))
        now[:, 1:] = np.maximum(np.maximum(diagonal, above), 0)
        begin[:, 1:] = np.where(now[:, 1:] == 0, steps[1:], np.where(diagonal >= above, start[:, :-1], start[:, 1:]))
        # gaps along the window: the best of all places before, one less per word between
        lifted = now + steps
        run = np.maximum.accumulate(lifted, axis=1)
        source = np.maximum.accumulate(np.where(lifted == run, steps, 0), axis=1)
        gap = (run - steps) > now
        begin = np.where(gap, np.take_along_axis(begin, source, axis=1), begin)
        score, start = np.maximum(now, run - steps), begin
        at = score.argmax(axis=1)
        better = score[every, at] > best
        best = np.where(better, score[every, at], best)
        first, last = np.where(better, start[every, at], first), np.where(better, at - 1, last)
    return best, first, last


class Seeds:
    """n-grams of items, sorted, with the item and place that each stands for."""

    def __init__(self, n: int, grams_: np.ndarray, owner: np.ndarray, place: np.ndarray):
        order = np.argsort(grams_, kind="stable")
        self.n, self.all, self.owner, self.place = n, grams_[order], owner[order], place[order]
        self._table()

    def _table(self):
        self.keys, first = np.unique(self.all, return_index=True)
        self.first = np.append(first, len(self.all))
        self.filter = np.zeros(1 << TABLE_BITS, bool)
        self.filter[self.keys >> np.uint64(64 - TABLE_BITS)] = True

    def hits(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `g` whose n-gram is a key, and the key's number."""
        at = np.flatnonzero(self.filter[g >> np.uint64(64 - TABLE_BITS)])
        k = np.searchsorted(self.keys, g[at])
        k[k == len(self.keys)] = 0
        same = self.keys[k] == g[at]
        return at[same], k[same]

    def choose(self, count: np.ndarray):
        """Keeps the rare ones of each item; count is by key."""
        own = count[np.searchsorted(self.keys, self.all)]
        limit = np.zeros(int(self.owner.max()) + 1)
        for i, c in zip(*_by_item(self.owner, own)):
            limit[i] = 2 * np.quantile(c, 0.25) + 2
        seed = own <= limit[self.owner]
        self.all, self.owner, self.place = self.all[seed], self.owner[seed], self.place[seed]
        self._table()


class Index:
    """Words and n-grams of a block of items: N-grams of all, and the whole sequence of those with fewer words."""

    def __init__(self, ids: list[int], texts: list[str]):
        h, first = word_hashes(texts, ALNUM, lower=True)
        self.ids = ids
        self.items = [h[a:b] for a, b in zip(first[:-1], first[1:])]
        size = np.diff(first)
        self.seeds = []
        for n in range(1, N + 1):
            g, at = grams(h, first, n)
            if not len(at):
                continue
            item = text_of(first)[at]
            whole = size[item] >= N if n == N else size[item] == n
            if whole.any():
                self.seeds.append(Seeds(n, g[whole], item[whole], (at - first[item])[whole]))

    def __len__(self):
        return sum(len(s.keys) for s in self.seeds)

    def counts(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """How often each key of all seeds, one kind after the other, stands in texts."""
        out = [np.zeros(0, np.int64)]
        for s in self.seeds:
            g, _ = grams(h, first, s.n)
            out.append(np.bincount(s.hits(g)[1], minlength=len(s.keys)) if len(g) else np.zeros(len(s.keys), np.int64))
        return np.concatenate(out)

    def choose(self, count: np.ndarray):
        """Keeps the seeds; count is by key."""
        at = 0
        for s in self.seeds:
            n = len(s.keys)
            s.choose(count[at : at + n])
            at += n
        return self

    def found(self, h: np.ndarray, first: np.ndarray):
        """(word, item, place) of every seed that stands in texts: each n-gram of a text with each place it has in an item."""
        out = []
        for s in self.seeds:
            g, at = grams(h, first, s.n)
            if not len(g):
                continue
            hit, key = s.hits(g)
            times = s.first[key + 1] - s.first[key]
            entry = np.repeat(s.first[key], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            out.append((np.repeat(at[hit], times), s.owner[entry], s.place[entry]))
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _by_item(owner: np.ndarray, values: np.ndarray):
    order = np.argsort(owner, kind="stable")
    ids, first = np.unique(owner[order], return_index=True)
    return ids, np.split(values[order], first[1:])


def _candidates(index: Index, h: np.ndarray, first: np.ndarray):
    """(text, item, begin, end) of the stretches to align, in words of all texts."""
    word, item, place = index.found(h, first)
    if not len(word):
        return []
    text = np.searchsorted(first, word, side="right") - 1
    diagonal = word - place
    order = np.lexsort((diagonal, item, text))
    text, item, place, diagonal = text[order], item[order], place[order], diagonal[order]
    size = np.array([len(x) for x in index.items])
    slack = size // 4 + 1
    # a new stretch begins where text or item change or diagonals are further apart than an alignment can bridge
    new = (np.diff(text, prepend=-1) != 0) | (np.diff(item, prepend=-1) != 0) | (np.diff(diagonal, prepend=0) > slack[item])
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(text))
    group = np.cumsum(new) - 1
    out = []
    for k in range(len(begins)):
        i, t = int(item[begins[k]]), int(text[begins[k]])
        low, high = diagonal[begins[k]] - slack[i], diagonal[ends[k] - 1] + size[i] + slack[i]
        out.append((t, i, max(int(low), int(first[t])), min(int(high), int(first[t + 1]))))
    return out


def _judge(index: Index, texts: list):
    """Best (score, item, first, last word) per text."""
    best: dict[int, tuple] = {}
    for a, b in slices(texts):
        h, first = word_hashes(texts[a:b], ALNUM, lower=True)
        todo: dict[int, list] = {}
        for c in _candidates(index, h, first):
            todo.setdefault(c[1], []).append(c)
        for i, cs in todo.items():
            cs.sort(key=lambda c: c[3] - c[2])
            at = 0
            while at < len(cs):  # windows of like width, a bounded number of cells at a time
                width = cs[at][3] - cs[at][2]
                end = at + 1
                while end < len(cs) and cs[end][3] - cs[end][2] <= 2 * width and (end - at) * width < 1 << 18:
                    end += 1
                w = cs[end - 1][3] - cs[end - 1][2]
                windows = np.zeros((end - at, w), np.uint64)
                for r, c in enumerate(cs[at:end]):
                    windows[r, : c[3] - c[2]] = h[c[2] : c[3]]
                score, begin, last = align(index.items[i], windows)
                for r, c in enumerate(cs[at:end]):
                    share = float(score[r]) / len(index.items[i])
                    found = (-share, index.ids[i], c[2] + int(begin[r]) - int(first[c[0]]), c[2] + int(last[r]) - int(first[c[0]]))
                    t = a + c[0]
                    best[t] = min(best.get(t, found), found)
                at = end
    return best


HITS = "_d binary, share double, item_id long, first_word long, last_word long"


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block: int = ITEMS) -> DataFrame:
    """Adds `contaminated`, `item_id` (the best item at the threshold or above), `overlap` (its score, or the best below), `first_word` and `last_word`."""
    return keeping(docs, ["text"], lambda kept: _judged(kept, items, threshold, block))


def _counts(sent):
    def count(batches):
        index = sent.value
        total = np.zeros(len(index), np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i, j in slices(texts):
                total += index.counts(*word_hashes(texts[i:j], ALNUM, lower=True))
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["key", "n"])

    return count


def _hits(sent):
    def judge(batches):
        for batch in batches:
            best = _judge(sent.value, batch.column(1).to_pylist())
            rows = sorted(best)
            columns = list(zip(*[best[t] for t in rows])) if rows else [[]] * 4
            made = [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, (pa.float64(), pa.int64(), pa.int64(), pa.int64()))]]
            yield pa.RecordBatch.from_arrays(made, names=["_d", "share", "item_id", "first_word", "last_word"])

    return judge


def _judged(kept: DataFrame, items: DataFrame, threshold: float, block: int) -> DataFrame:
    spark = kept.sparkSession
    keyed = kept.withColumn("_d", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    items = items.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    blocks = max(1, -(-items.count() // block))
    found = None
    for b in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()  # a bounded block
        index = Index([r["item_id"] for r in mine], [r["text"] for r in mine])
        sent = spark.sparkContext.broadcast(index)
        # one row per n-gram of the block
        got = kept.select("text").mapInArrow(_counts(sent), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
        sent.destroy()
        total = np.zeros(len(index), np.int64)
        total[got["key"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
        sent = spark.sparkContext.broadcast(index.choose(total))
        hits = settle(keyed.select("_d", "text").mapInArrow(_hits(sent), HITS), "leak-hits")
        sent.destroy()
        found = hits if found is None else found.unionByName(hits)
    # copies of a text have one digest and one result
    best = found.groupBy("_d").agg(F.min(F.struct("share", "item_id", "first_word", "last_word")).alias("_b"))
    out = small_join(keyed, settle(best, "leak-best"), ["_d"], "left")
    held = F.coalesce(-F.col("_b.share") >= threshold, F.lit(False))
    made = {c: F.when(held, F.col(f"_b.{c}")) for c in ("item_id", "first_word", "last_word")}
    overlap = F.coalesce(-F.col("_b.share"), F.lit(0.0))
    return out.select(*kept.columns, held.alias("contaminated"), made["item_id"].alias("item_id"), overlap.alias("overlap"), made["first_word"].alias("first_word"), made["last_word"].alias("last_word"))
