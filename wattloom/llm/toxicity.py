"""Toxicity: a weighted lexicon matched by Aho-Corasick in folded text, normalised by length, with exception phrases.

Folding lower-cases, takes compatibility forms and accents away, maps look-alike letters and digit substitutions to plain letters and everything between words to a space.
The lexicon starts from `BASE` and learns from labels: words of any length, word beginnings, and, in runs of more than `RUN` letters such as scripts without spaces have, runs of
`GRAMS` letters beyond ASCII, that toxic texts use far more often than clean ones, weighted by that log ratio. The automaton finds such a run of letters wherever it stands. Hits inside an exception phrase do not count. A logistic curve over the summed weight and the weight per hundred words gives the score.

Learning: a documented bounded sample, about `TOXIC` toxic and `CLEAN` clean labelled texts drawn by hash of the id; the lexicon
holds the `terms` (a parameter, `TERMS` unless given) that most toxic texts of the sample use.
The automaton and the curve are the only things broadcast.

Defined results: a null or empty text has no hits and gets the curve's value there. A document with several labels is toxic if one of them
says so; null labels are ignored. Without both kinds of labels only `BASE` counts, with a fixed curve. Rows that repeat are scored each.
Input columns named like a result are replaced; others are kept.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from wattloom.llm.common import settle

# fixed values: insults every lexicon starts from, and phrases in which such words are harmless
BASE = (
    "idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "imbecile", "dumbass", "bastard", "bitch",
    "asshole", "fuck", "fucking", "shit", "cunt", "whore", "retard", "retarded", "vermin", "filth", "subhuman",
)
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "class clown", "pond scum", "not stupid", "stupid simple", "bastard file", "bastard sword", "loser bracket")
# fixed values: look-alike letters of other scripts, and substitutions
LOOKS_LIKE = {
    "a": "аα@4ａ", "b": "ьвｂ8", "c": "сϲｃ", "d": "ԁｄ", "e": "еεҽｅ3€", "g": "ɡｇ9", "h": "һнｈ", "i": "іıιｉ1!|", "j": "јｊ", "k": "κкｋ", "l": "ⅼｌ",
    "m": "мｍ", "n": "ոｎ", "o": "оοօｏ0", "p": "рρｐ", "q": "ԛｑ", "s": "ѕｓ5$", "t": "тτｔ7+", "u": "υսｕ", "v": "νѵｖ", "w": "ԝｗ", "x": "хχｘ", "y": "уγｙ", "z": "ᴢｚ2",
}
TOXIC, CLEAN = 15_000, 45_000
TERMS = 5_000
PREFIXES = (4, 5, 6)
RUN, GRAMS = 20, (2, 3, 4)
LEAST_TEXTS, LEAST_RATIO, MOST_WEIGHT = 4, 3.0, 6.0
BASE_WEIGHT, BASE_CURVE = 4.0, (-4.0, 2.0, 1.0)
THRESHOLD = 0.3


@functools.lru_cache(maxsize=1)
def _folds() -> dict[int, str]:
    out = {i: " " for i in range(128) if not chr(i).isalnum()} | {0xAD: "", 0x200B: "", 0x200C: "", 0x200D: ""} | {i: "" for i in range(0x300, 0x370)}
    return out | {ord(c): k for k, cs in LOOKS_LIKE.items() for c in cs}


def fold(text: str | None) -> str:
    """Words in plain small letters, one space before and behind each."""
    plain = (text or "").lower()
    if not plain.isascii():
        plain = unicodedata.normalize("NFKD", plain)
    return " " + " ".join(plain.translate(_folds()).split()) + " "


def _terms(folded: str) -> set[str]:
    """Whole words as ` word `, beginnings as ` begin`, runs of letters beyond ASCII in long words as they are."""
    words = set(filter(None, folded.split(" ")))
    found = {f" {w} " for w in words} | {" " + w[:n] for w in words if len(w) > min(PREFIXES) for n in PREFIXES if len(w) > n}
    for w in words:
        if len(w) > RUN and not w.isascii():
            runs = (w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1))
            found.update(g for g in runs if not any(c.isascii() for c in g))
    return found


class Matcher:
    """Summed weight of the lexicon's hits in a text. Of hits that begin with one word the heaviest counts."""

    def __init__(self, lexicon: dict[str, float], exceptions=EXCEPTIONS):
        import ahocorasick

        self.find = ahocorasick.Automaton()
        for t, w in lexicon.items():
            self.find.add_word(t, (len(t), w))
        for e in exceptions:
            self.find.add_word(fold(e), (len(fold(e)), 0.0))
        self.find.make_automaton()

    def features(self, text: str | None) -> tuple[float, int]:
        """Weight, and number of words."""
        folded = fold(text)
        best: dict[int, float] = {}
        free: list[tuple[int, int]] = []
        for end, (n, w) in self.find.iter(folded):
            at = end - n + 1
            if w:
                best[at] = max(w, best.get(at, 0.0))
            else:
                free.append((at, end))
        total = 0.0
        reach = -1
        free.sort()
        k = 0
        for at in sorted(best):
            while k < len(free) and free[k][0] <= at:
                reach = max(reach, free[k][1])
                k += 1
            # the word's own space at its end may be the phrase's last character
            if at >= reach:
                total += best[at]
        return total, folded.count(" ") - 1 if len(folded) > 2 else 0


def _shape(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(weight), np.log1p(weight), np.log1p(100 * weight / np.maximum(words, 20))], axis=1)


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a ridge on all but the constant."""
    beta = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(b) for b in beta)


def learn(docs: DataFrame, labels: DataFrame, terms: int = TERMS) -> tuple[dict[str, float], tuple[float, ...]]:
    """Lexicon and curve from (doc_id, text) and (doc_id, toxic)."""
    base = {f" {fold(w).strip()} ": BASE_WEIGHT for w in BASE}
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(n) < 2:
        return base, BASE_CURVE
    rate = F.when(F.col("toxic") == 1, F.lit(TOXIC / n[1])).otherwise(F.lit(CLEAN / n[0]))
    drawn = known.filter(F.pmod(F.xxhash64(F.lit("tox"), "doc_id"), F.lit(1 << 30)) / float(1 << 30) < rate)
    # the sample's size is bounded by TOXIC and CLEAN
    sample = settle(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", "toxic").dropDuplicates(), "toxic-sample")
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(size) < 2:
        return base, BASE_CURVE

    def count(batches):
        seen: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([t for t, _ in seen], pa.string()), pa.array([x for _, x in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["term", "toxic", "n"])
            seen.clear()
            return out

        for batch in batches:
            for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.update([(k, x) for k in _terms(fold(t))])
            if len(seen) > 100_000:
                yield flush()
        yield flush()

    # the sample is dealt evenly, so that it is counted by as many tasks as there are
    even = sample.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    used = even.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(count, "term string, toxic int, n long")
    by = used.groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n"))).alias("bad"), F.coalesce(F.sum(F.when(F.col("toxic") == 0, F.col("n"))), F.lit(0)).alias("good"))
    ratio = F.log((F.col("bad") + 0.1) / (size[1] + 0.2)) - F.log((F.col("good") + 0.1) / (size[0] + 0.2))
    telling = by.filter(F.col("bad") >= LEAST_TEXTS).withColumn("ratio", ratio).filter(F.col("ratio") >= LEAST_RATIO)
    # the most frequent terms of the toxic texts; their number bounds the model
    top = telling.orderBy(F.desc("bad"), "good", "term").limit(terms).collect()
    lexicon = base | {r["term"]: round(min(MOST_WEIGHT, r["ratio"]), 6) for r in top}
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def features(batches):
        matcher = Matcher(shared.value)
        for batch in batches:
            got = [matcher.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64()), batch.column(1)], names=["weight", "words", "toxic"])

    points = sample.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(features, "weight double, words long, toxic int")
    # equal points merge; at most one per sampled text comes to the driver
    p = points.groupBy("weight", "words", "toxic").agg(F.count(F.lit(1)).alias("n")).orderBy("weight", "words", "toxic").toPandas()
    x = np.repeat(_shape(p["weight"].to_numpy(float), p["words"].to_numpy(float)), p["n"], axis=0)
    return lexicon, _curve(x, np.repeat(p["toxic"].to_numpy(float), p["n"]))


def score(docs: DataFrame, model: tuple[dict[str, float], tuple[float, ...]]) -> DataFrame:
    """Adds `score` and `predicted` to documents."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("score", "predicted")
    at = kept.columns.index("text")
    schema = StructType([*kept.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def scored(batches):
        lexicon, curve = shared.value
        matcher = Matcher(lexicon)
        for batch in batches:
            got = [matcher.features(t) for t in batch.column(at).to_pylist()]
            z = [float(v) for v in _shape(np.array([g[0] for g in got], float), np.array([g[1] for g in got], float)) @ np.array(curve)]
            s = [1 / (1 + math.exp(-max(-30.0, min(30.0, v)))) for v in z]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array([int(v >= THRESHOLD) for v in s], pa.int32())], names=[*batch.schema.names, "score", "predicted"])

    return kept.mapInArrow(scored, schema)
