"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and everything that is no letter becomes a space; n-grams of one to three characters fall into buckets by a hash. Counts of
buckets per language give a matrix of log probabilities, which is broadcast; a batch of texts is scored as a sparse product, one look-up per n-gram
and one sum per text.

Learning: `SAMPLE` labelled texts per language at most, drawn by hash of id and text (a documented bound of the classifier's sample). Matrix size is
bounded by `CELLS`: the more languages, the fewer buckets.

Defined results: a text that is null, empty or without a letter is `und` with score 0. Equal posteriors go to the first language in code point order.
Rows that repeat are scored each. Without any labelled text all is `und`, score 0. Input columns named like a result are replaced; others are kept.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDERS = 3
SAMPLE = 20_000
CELLS = 1 << 20
BUCKETS = 1 << 15
SMOOTHING = 0.5
PIECE = 1 << 17
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(letters()[c], c, 32)


def _grams(codes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and first place of each n-gram with a letter. Codes hold zeros between texts; no n-gram crosses them."""
    bits = buckets.bit_length() - 1
    x, places = codes.astype(np.uint64), np.arange(len(codes))
    g = np.zeros(len(codes), np.uint64)
    blank, found, where = np.ones(len(codes), bool), [], []
    inside = np.ones(len(codes), bool)
    for n in range(ORDERS):
        m = len(codes) - n
        if m <= 0:
            break
        tail = x[n:]
        g = g[:m] * np.uint64(0x9E3779B97F4A7C15) + tail + np.uint64(n + 1)
        inside = inside[:m] & (tail > 0)
        blank = blank[:m] & (tail == 32)
        keep = inside & ~blank
        h = g[keep] * np.uint64(0xD6E8FEB86659FD93)
        found.append(((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - bits)).astype(np.int64))
        where.append(places[:m][keep])
    return (np.concatenate(found), np.concatenate(where)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _runs(texts: list, limit: int):
    """Runs of pieces: (text numbers, start of each piece in the codes, codes). A long text comes in pieces that overlap by an n-gram less one."""
    numbers, starts, parts, size = [], [], [], 0
    for i, t in enumerate(texts):
        if not t:
            continue
        codes = _codes(t)
        for at in range(0, len(codes), limit):
            # n-grams that begin in the overlap belong to the next piece and are not counted here
            piece = codes[at : at + limit + ORDERS - 1]
            numbers.append((i, min(limit, len(codes) - at)))
            starts.append(size)
            parts += [piece, np.zeros(1, piece.dtype)]
            size += len(piece) + 1
            if size >= limit:
                yield numbers, np.array(starts), np.concatenate(parts)
                numbers, starts, parts, size = [], [], [], 0
    if numbers:
        yield numbers, np.array(starts), np.concatenate(parts)


def _placed(run, buckets: int):
    """Buckets of a run's n-grams, and the text number of each."""
    numbers, starts, codes = run
    found, places = _grams(codes, buckets)
    piece = np.searchsorted(starts, places, side="right") - 1
    own = places - starts[piece] < np.array([n for _, n in numbers])[piece]
    return found[own], np.array([i for i, _ in numbers])[piece[own]]


def learn(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages, and the matrix (buckets + 1) x languages of log probabilities whose last row is the prior, from (doc_id, text, lang)."""
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per language
    names = sorted(r["lang"] for r in counts)
    if not names:
        return [], np.zeros((1, 0))
    number = {r: i for i, r in enumerate(names)}
    buckets = BUCKETS
    while buckets > 256 and buckets * len(names) > CELLS:
        buckets //= 2
    share = F.element_at(F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, sample / r["n"])))]), F.col("lang"))
    draw = F.pmod(F.xxhash64(F.lit("lang"), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)

    def count(batches):
        total = np.zeros(len(names) * buckets, np.int64)
        for batch in batches:
            lang = np.array([number[x] for x in batch.column(1).to_pylist()])
            for run in _runs(batch.column(0).to_pylist(), PIECE):
                found, text = _placed(run, buckets)
                total += np.bincount(lang[text] * buckets + found, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    cells = rows.filter(draw < share).select("text", "lang").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    got = cells.toPandas()  # CELLS rows at most
    table = np.zeros((len(names), buckets))
    table.ravel()[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy()
    chance = np.log(table + SMOOTHING) - np.log(table.sum(axis=1, keepdims=True) + SMOOTHING * buckets)
    drawn = np.array([float(dict((r["lang"], r["n"]) for r in counts)[x]) for x in names])
    return names, np.vstack([chance.T, np.log(drawn / drawn.sum())])


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """Adds `lang_pred` and `score` (posterior of the predicted language) to documents."""
    names, matrix = model
    shared = docs.sparkSession.sparkContext.broadcast(matrix)
    kept = docs.drop("lang_pred", "score")
    at = kept.columns.index("text")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields] + ["lang_pred string", "score double"])

    def score(batches):
        weights = shared.value
        buckets = len(weights) - 1
        limit = max(4096, min(PIECE, (1 << 21) // max(1, len(names))))
        for batch in batches:
            texts = batch.column(at).to_pylist()
            known = np.array([bool(names) and any(map(str.isalpha, t or "")) for t in texts], bool)
            total = np.tile(weights[-1], (len(texts), 1))
            if names:
                for run in _runs(texts, limit):
                    found, text = _placed(run, buckets)
                    order = np.argsort(text, kind="stable")
                    found, text = found[order], text[order]
                    first = np.flatnonzero(np.diff(text, prepend=-1))
                    if len(first):
                        total[text[first]] += np.add.reduceat(weights[found], first, axis=0)
                best = total.argmax(axis=1)
                share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            lang = [names[best[i]] if k else UNKNOWN for i, k in enumerate(known)]
            sure = [float(share[i]) if k else 0.0 for i, k in enumerate(known)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(sure, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(score, schema)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))
