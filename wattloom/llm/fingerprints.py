"""Fingerprints of documents from their improbable byte windows.

Every window of WINDOW bytes has an entropy; how often an entropy level occurs in all texts is its rarity, and rare levels rank first. A window that is the
first of the lowest rank in at least POPULAR of the RUN runs of RUN windows around it is a feature. A text's distinct features, in their order, go into a chain
of Bloom filters of BITS bits, HASHES bits a feature and FILL features a filter. Two fingerprints are as like as the filters of the shorter one find
bits in common with their best partners in the longer one, less what chance gives, weighted by their features.

Texts are moved once: they are sorted by id in ranges, where every document finds the next one; only the first and last document of a range go on to meet across ranges.

Defined results: a null text is empty. A text shorter than a window is one feature as a whole; an empty text has none and the empty fingerprint. Equal
fingerprints, two empty ones included, have likeness 1; an empty one and another have 0. Documents stand in descending order of their ids, nulls last, rows
of one id in the order of their texts; a table of one document has itself as the next one; an empty table gives no rows. Very long texts are cut for
computation at overlapping windows, with the same result. Only doc_id and text are read, so extra columns change nothing.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattloom.llm.common import settle

WINDOW, RUN, POPULAR = 64, 64, 16
LEVELS = 1000  # entropy levels, of at most log2(WINDOW) bits
WEAK = 100  # levels below say little and rank last
BITS, HASHES, FILL = 2048, 5, 160
CHANCE = 0.1  # overlap beyond chance below which filters have nothing in common
BATCH = 1 << 20  # bytes of text that are computed together

_COUNTS = np.arange(WINDOW + 1, dtype=np.float64)
_SCALE = 1 << 20  # entropies are sums of whole numbers, so that a window's does not depend on what stands before it
_SHARE = np.rint(_COUNTS * np.log2(np.maximum(_COUNTS, 1)) * _SCALE).astype(np.int64)
_STEP = np.diff(_SHARE).astype(np.int32)
_FULL = int(_SHARE[WINDOW])


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """Entropy level, 0 to LEVELS, of every window of bytes.

    Moving a window by one byte changes the sum over its byte counts by a step that depends on how often the byte that enters stands in the
    63 places before it, and one that depends on how often the byte that leaves stands in the 63 behind it; both counts come from comparing the bytes with themselves moved.
    """
    n = len(data) - WINDOW + 1
    before, behind = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    same = np.empty(len(data), np.uint8)
    for k in range(1, WINDOW):
        s = same[: len(data) - k]
        np.equal(data[k:], data[:-k], out=s.view(bool))
        before[k:] += s
        behind[:-k] += s
    first = int(_SHARE[np.bincount(data[:WINDOW])].sum())
    sums = np.empty(n, np.int64)
    sums[0] = first
    np.cumsum(_STEP[before[WINDOW:]] - _STEP[behind[: n - 1]], dtype=np.int64, out=sums[1:])
    sums[1:] += first
    return ((_FULL - sums) * LEVELS // _FULL).astype(np.int16)


def _windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of texts of WINDOW bytes or more in a row, the text that each window lies in, and whether it lies in one."""
    size = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(len(texts)), size)[: len(data) - WINDOW + 1]
    inside = np.ones(len(owner), bool)
    for end in np.cumsum(size)[:-1]:
        inside[end - WINDOW + 1 : end] = False
    return data, owner, inside


def _parts(text: bytes, most: int):
    """A text in parts of `most` windows, each with the byte at which it starts and the windows before and behind that its features depend on."""
    windows = len(text) - WINDOW + 1
    for begin in range(0, windows, most):
        low, high = max(0, begin - RUN + 1), min(windows, begin + most + RUN - 1)
        yield low, begin, min(windows, begin + most), text[low : high + WINDOW - 1]


def level_counts(texts: list[bytes]) -> np.ndarray:
    """Windows of each entropy level."""
    counts = np.zeros(LEVELS + 1, np.int64)
    for group in _groups([t for t in texts if len(t) >= WINDOW]):
        if len(group) == 1:
            found = [entropy_levels(np.frombuffer(t, np.uint8))[begin - low : end - low] for low, begin, end, t in _parts(group[0], BATCH)]
        else:
            data, _, inside = _windows(group)
            found = [entropy_levels(data)[inside]]
        for levels in found:
            counts += np.bincount(levels, minlength=LEVELS + 1)
    return counts


def _groups(texts: list[bytes]):
    """Runs of texts of about BATCH bytes; longer texts stand alone."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > BATCH:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each entropy level: the rarest that occurs first, weak levels last; of equally rare ones the higher entropy first."""
    level = np.arange(LEVELS + 1)
    order = np.lexsort((-level, counts, level < WEAK))
    out = np.empty(LEVELS + 1, np.int32)
    out[order] = level
    return out


def popularity(rank: np.ndarray) -> np.ndarray:
    """In how many runs of RUN windows each window is the first of the lowest rank; windows of a rank above LEVELS never are, and stand for what lies outside of texts."""
    edge = np.full(RUN - 1, LEVELS + 1, np.int64)
    key = np.concatenate([edge, rank, edge])
    key = key << 32 | np.arange(len(key))
    low, size = key, 1
    while size < RUN:  # RUN is a power of two
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = low[low >> 32 <= LEVELS] & 0xFFFFFFFF
    return np.bincount(low - (RUN - 1), minlength=len(rank))[: len(rank)]


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def _hashed(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the windows that start at the given bytes."""
    words = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[at].view("<u8")
    h = np.zeros(len(at), np.uint64)
    for k in range(WINDOW // 8):
        h = (h ^ words[:, k]) * _MIX[k]
        h ^= h >> np.uint64(29)
    h *= _MIX[0]
    return h ^ h >> np.uint64(32)


def _features(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """Hashes of each text's features in their order."""
    out: list = [None] * len(texts)
    long = []
    for i, t in enumerate(texts):
        if len(t) >= WINDOW:
            long.append(i)
        else:
            short = hashlib.sha256(t).digest()[:8] if t else b""
            out[i] = np.frombuffer(short, "<u8")
    group: list[int] = []
    size = 0
    for i in [*long, None]:
        if group and (i is None or size + len(texts[i]) > BATCH):
            if len(group) == 1:
                out[group[0]] = _features_of_one(texts[group[0]], rank)
            else:
                data, owner, inside = _windows([texts[g] for g in group])
                levels = np.where(inside, rank[entropy_levels(data)], LEVELS + 1)
                at = np.flatnonzero(popularity(levels) >= POPULAR)
                ends = np.searchsorted(owner[at], np.arange(1, len(group)))
                for g, own in zip(group, np.split(_hashed(data, at), ends)):
                    out[g] = own
            group, size = [], 0
        if i is not None:
            group.append(i)
            size += len(texts[i])
    return out


def _features_of_one(text: bytes, rank: np.ndarray) -> np.ndarray:
    found = []
    for low, begin, end, part in _parts(text, BATCH):
        data = np.frombuffer(part, np.uint8)
        at = np.flatnonzero(popularity(rank[entropy_levels(data)]) >= POPULAR)
        found.append(_hashed(data, at[(at >= begin - low) & (at < end - low)]))
    return np.concatenate(found)


def digests(texts: list[str], rank: np.ndarray) -> list[bytes]:
    """Fingerprints: for each filter of the chain a byte with the number of its features, and its bits."""
    out = []
    for hashes in _features([t.encode("utf-8", "surrogatepass") for t in texts], rank):
        _, first = np.unique(hashes, return_index=True)
        own = hashes[np.sort(first)]
        chain = []
        for begin in range(0, len(own), FILL):
            h = own[begin : begin + FILL]
            bits = np.zeros(BITS, np.uint8)
            for k in range(HASHES):
                bits[(h >> np.uint64(11 * k) & np.uint64(BITS - 1)).astype(np.int64)] = 1
            chain.append(bytes([len(h)]) + np.packbits(bits).tobytes())
        out.append(b"".join(chain))
    return out


def _chain(digest: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(digest, np.uint8).reshape(-1, 1 + BITS // 8)
    return rows[:, 0].astype(np.float64), np.unpackbits(rows[:, 1:], axis=1).astype(np.float32)


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1: bits that the filters of the shorter fingerprint share with their best partners, beyond chance, weighted by features."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    if (len(a), a) > (len(b), b):
        a, b = b, a
    weight, x = _chain(a)
    _, y = _chain(b)
    one, other = x.sum(axis=1)[:, None].astype(np.float64), y.sum(axis=1)[None, :].astype(np.float64)
    best = np.zeros(len(x))
    for begin in range(0, len(y), 1024):  # a long chain is met in parts
        o = other[:, begin : begin + 1024]
        chance = one * o / BITS
        room = np.maximum(np.minimum(one, o) - chance, 1e-9)
        best = np.maximum(best, ((x @ y[begin : begin + 1024].T - chance) / room).max(axis=1))
    best = np.where(best < CHANCE, 0.0, np.minimum(best, 1.0))
    return float(round((best * weight).sum() / weight.sum(), 9))


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the first as many characters of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def entropy_ranks(docs: DataFrame) -> np.ndarray:
    """Ranks of the entropy levels, from counts over all windows of all texts: one row of at most LEVELS + 1 counts per task."""

    def counts(batches):
        total = np.zeros(LEVELS + 1, np.int64)
        for batch in batches:
            total += level_counts([(t or "").encode("utf-8", "surrogatepass") for t in batch.column(0).to_pylist()])
        level = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(level, pa.int64()), pa.array(total[level], pa.int64())], names=["level", "n"])

    found = docs.select("text").mapInArrow(counts, "level long, n long").groupBy("level").agg(F.sum("n").alias("n"))
    total = np.zeros(LEVELS + 1, np.int64)
    for level, n in found.collect():  # at most LEVELS + 1 rows
        total[level] = n
    return ranks(total)


ROWS = (
    "shard int, place long, doc_id long, n_chars long, text string, edited_sha256 string, digest binary, edited_digest binary, near_edited double, near_next double"
)
TYPES = pa.schema(
    [("shard", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("text", pa.string()), ("edited_sha256", pa.string()),
     ("digest", pa.binary()), ("edited_digest", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def neighbours(docs: DataFrame, rank: np.ndarray, shards: int | None = None) -> DataFrame:
    """Rows of ROWS: documents in descending order within ranges; the first and last of a range keep their text, and the last waits for its next document."""
    spark = docs.sparkSession
    shards = shards or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def rows(batches):
        shard, place = TaskContext.get().partitionId(), 0
        held: list = []  # (doc_id, text, digest) of documents whose next one is not known yet

        def finished(known: list, last: bool):
            """Rows of all but the last document; the last one too at the end of the range."""
            nonlocal place
            texts = [edited(a[1], b[1]) for a, b in zip(known, known[1:])]
            out = []
            for (i, t, d), (_, _, nxt), e, g in zip(known, known[1:], texts, digests(texts, rank)):
                out.append((shard, place, i, len(t), t if place == 0 else None, _sha(e), d, g, likeness(d, g), likeness(d, nxt)))
                place += 1
            if last:
                i, t, d = known[-1]
                out.append((shard, place, i, len(t), t, None, d, None, None, None))
            return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out), TYPES)], schema=TYPES) if out else None

        for ids, texts in _few(batches):
            held += zip(ids, texts, digests(texts, rank))
            out = finished(held, False)
            held = held[-1:]
            if out:
                yield out
        if held:
            yield finished(held, True)

    by = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # rows of one id are dealt by their texts' beginnings, which order as the texts do
    dealt = dealt.repartitionByRange(shards, by[0], F.substring("text", 1, 16)).sortWithinPartitions(*by)
    return settle(dealt.mapInArrow(rows, ROWS), "fingerprints")


def _few(batches, most: int = 1 << 20):
    """Runs of rows with about `most` characters of text."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size > most:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def fingerprints(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    rank = entropy_ranks(docs)
    rows = neighbours(docs, rank, shards)
    # one row per range: the range that comes next, the first one again after the last
    begins = rows.filter(F.col("place") == 0)
    order = Window.orderBy("shard")
    shards = begins.select("shard", F.coalesce(F.lead("shard").over(order), F.first("shard").over(order)).alias("_next"))
    following = shards.join(begins.select(F.col("shard").alias("_next"), F.col("text").alias("_text"), F.col("digest").alias("_digest")), "_next").drop("_next")
    waiting = rows.filter(F.col("edited_sha256").isNull()).join(following, "shard")

    def ends(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                e = edited(r["text"], r["_text"])
                (g,) = digests([e], rank)
                out.append((r["shard"], r["place"], r["doc_id"], r["n_chars"], None, _sha(e), r["digest"], g, likeness(r["digest"], g), likeness(r["digest"], r["_digest"])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out), TYPES)], schema=TYPES)

    whole = rows.filter(F.col("edited_sha256").isNotNull()).unionByName(waiting.mapInArrow(ends, ROWS))
    return whole.select(
        "doc_id", "n_chars", "edited_sha256", F.base64("digest").alias("fingerprint"), F.base64("edited_digest").alias("edited_fingerprint"), "near_edited", "near_next"
    )


def fingerprint_bytes(fingerprint: str) -> bytes:
    """The digest that a fingerprint is the text of."""
    return base64.b64decode(fingerprint)
