"""Exact top-k by inner product with the no-random-access algorithm (score bounds from sorted lists).

Every block of vectors has one list per dimension, sorted by component. For a query the lists are read in step, from the end that contributes most. A
vector read in some lists has an upper bound, what was read plus the last value read of every other list, and a lower bound, what was read plus the least value of
every other list. The k-th best lower bound is the bar: reading stops when no vector outside of a small set can reach it, read or not. The final scores of
that set are then resolved from its vectors. Small blocks go the same way as large ones.

Lists are read to the same depths for all queries. Down to a depth, a vector's share of a bound in one dimension is its component where the list was read up to it, else the last
component read (upper) or the list's end (lower), whatever the query; only the sign of the query's component says from which end the list is read. So the bounds of
a batch of queries are products with four tables of the block, made once per depth. A block is built once in a task; the queries, dealt to all blocks, stream past it
in batches, and only k rows per query and block leave it.

Defined results: vectors that are null or hold null or non-finite components take no part; empty vectors neither. Scores of vectors of unequal
length do not exist, so lengths never meet. Rows that repeat are rows of their own; a query's own row is left out by its place in the written table.
Ties go to the smaller vec_id, then to the earlier row. Bounds are whole numbers and exact; where a sum could pass 2^52 they say nothing, all lists are read to the end, and scores wrap as 64-bit
integers do. An empty table has no results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.llm.common import settle

VECTORS = 4_096  # rows of a block
BATCH = 256  # queries that are searched together
DEPTHS = (0.25, 0.5, 0.75, 1.0)
FEW = 1 / 24  # share of a block that may be left to resolve at the end
RESULT = "query_id long, _query long, vec_id long, _row long, score long"
TYPES = pa.schema([(c, pa.int64()) for c in ("query_id", "_query", "vec_id", "_row", "score")])


class Block:
    """Vectors of one length and their sorted lists, in the narrowest integers that hold them."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        kind = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= x.min() and x.max() <= np.iinfo(t).max)
        self.x, self.ids, self.rows = x.astype(kind), ids, rows
        self.place = {int(r): i for i, r in enumerate(rows)}
        self.lists = np.sort(self.x, axis=0)  # per dimension, ascending
        self.most = np.maximum(np.abs(self.lists[0].astype(float)), np.abs(self.lists[-1].astype(float)))
        self.tables: dict[int, tuple] = {}

    def _tables(self, end: int) -> tuple:
        """What every component adds at most and at least, per unit of a positive and of a negative query component, after `end` entries of all lists."""
        if end not in self.tables:
            high, low = self.lists[len(self.x) - end], self.lists[end - 1]
            least = np.where(self.x >= high, self.x, self.lists[0]), np.where(self.x <= low, self.x, self.lists[-1])
            self.tables[end] = tuple(t.astype(float) for t in (np.maximum(self.x, high), np.minimum(self.x, low), *least))
        return self.tables[end]

    def bounds(self, queries: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all rows (down) for queries (across) after `end` entries of all lists."""
        up, down, least_up, least_down = self._tables(end)
        plus, minus = np.maximum(queries, 0).T.astype(float), np.minimum(queries, 0).T.astype(float)
        return least_up @ plus + least_down @ minus, up @ plus + down @ minus

    def candidates(self, queries: np.ndarray, owns: list[int], k: int) -> list[np.ndarray]:
        """Per query the places of the rows that may be among its k best other than its own, by the lists alone."""
        n = len(self.x)
        own = [self.place.get(int(o)) for o in owns]
        out = [np.delete(np.arange(n), [] if o is None else o) for o in own]
        unsure = np.flatnonzero(np.abs(queries.astype(float)) @ self.most < 2.0**52)
        for depth in DEPTHS:
            unsure = np.array([j for j in unsure if len(out[j]) > max(8 * k, FEW * n)], int)
            if not len(unsure):
                break
            lower, upper = self.bounds(queries[unsure], min(n, int(np.ceil(n * depth))))
            for c, j in enumerate(unsure):
                if own[j] is not None:
                    lower[own[j], c] = upper[own[j], c] = -np.inf
            bar = np.partition(lower, n - k, axis=0)[n - k] if n > k else np.full(len(unsure), -np.inf)
            reach = upper >= np.maximum(bar, -(2.0**60))
            for c, j in enumerate(unsure):
                out[j] = np.flatnonzero(reach[:, c])
        return out

    def search(self, queries: np.ndarray, owns: list[int], k: int) -> list[list[tuple[int, int]]]:
        """Per query the places and scores of its k best rows other than its own."""
        found = []
        for q, places in zip(queries, self.candidates(queries, owns, k)):
            score = self.x[places].astype(np.int64) @ q
            if len(places) > 4 * k:
                cut = np.partition(score, len(score) - k)[len(score) - k]
                places, score = places[score >= cut], score[score >= cut]
            best = np.lexsort((self.rows[places], self.ids[places], -score))[:k]
            found.append([(int(places[i]), int(score[i])) for i in best])
        return found


def vectors(table: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v) with integer components of the rows that take part."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & (F.size("embedding") > 0)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return table.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & usable).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def _searched(k: int):
    """Rows (length, block, query or not, id, row, vector), sorted, to RESULT: a block's own rows come first and are built once, its queries follow in batches of any size."""

    def run(batches):
        key, ids, rows, xs, block, waiting = None, [], [], [], None, []

        def flush():
            nonlocal waiting
            found = block.search(np.stack([x for _, _, x in waiting]), [row for _, row, _ in waiting], k)
            out = [(name, row, int(block.ids[p]), int(block.rows[p]), s) for (name, row, _), best in zip(waiting, found) for p, s in best]
            waiting = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 5)], schema=TYPES)

        for batch in batches:
            for d, b, asked, name, row, v in zip(*[c.to_pylist() if i < 5 else c for i, c in enumerate(batch.columns)]):
                if (d, b) != key:
                    if waiting:
                        yield flush()
                    key, ids, rows, xs, block = (d, b), [], [], [], None
                x = np.asarray(v.values, np.int64)
                if not asked:
                    ids.append(name)
                    rows.append(row)
                    xs.append(x)
                elif xs or block:
                    if block is None:
                        block = Block(np.stack(xs), np.array(ids), np.array(rows))
                        xs = []
                    waiting.append((name, row, x))
                    if len(waiting) == BATCH:
                        yield flush()
        if waiting:
            yield flush()

    return run


def top_k(vecs: DataFrame, is_query: Column, k: int = 5, block: int = VECTORS) -> DataFrame:
    """query_id, rank, vec_id, score of the k best other rows for every row of (vec_id, v) that is a query."""
    rows = settle(vecs.withColumn("_row", F.monotonically_increasing_id()).withColumn("_d", F.size("v")), "vectors")
    blocks = -(-rows.count() // block) or 1
    columns = ["_d", "_b", "_asked", "vec_id", "_row", "v"]
    own = rows.withColumns({"_b": F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int"), "_asked": F.lit(0)})
    asked = rows.filter(is_query).withColumns({"_b": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "_asked": F.lit(1)})
    spark = vecs.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), blocks)
    dealt = own.select(*columns).unionByName(asked.select(*columns)).repartition(tasks, "_d", "_b").sortWithinPartitions(*columns[:5])
    near = dealt.mapInArrow(_searched(k), RESULT)
    # k rows per query and block
    order = Window.partitionBy("_query").orderBy(F.desc("score"), "vec_id", "_row")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
