"""What operators learn and find, against plain versions: toxicity, language, decontamination, top-k; and foreign columns through the pipeline."""

import math
import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.llm import decontaminate, language, licenses, pii, substrings, topk, toxicity
from wattloom.llm.common import settle, table
from wattloom.llm.words import ALNUM, word_hashes


@pytest.fixture(autouse=True)
def settings(spark, sf_dir):
    table(spark, sf_dir, "documents")


# --- toxicity ------------------------------------------------------------------------------------
def test_scripts_without_spaces_are_learned(spark):
    rng = random.Random(1)
    letters = "的一是在不了有和人这中大为上个国我以要他时来用们生到作地于出就分对成会可主发年动同工也能下过子说产种面而方后多定行学法所民得经十三之进着等部度家电力里如水化高自二理起小物现实加量都两体制机当使点从业本去把性好应开它合还因由其些然前外天政四日那社义事平形相全表间样与关各重新线内数正心反你明看原又么利比或但质气第向道命此变条只没结解问意建月公无系军很情者最立代想已通并提直题党程展五果料象员革位入常文总次品式活设及管特件长求老头基资边流路级少图山统接知较将组见计别她手角期根论运农指几九区强放决西被干做必战先回则任取据处理世车"
    say = lambda: "".join(rng.choice(letters) for _ in range(60))
    bad = "你这个没用的垃圾滚出去"
    texts = [(i, say() + (bad if i % 2 else "") + say()) for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    new = [(1000 + i, say() + (bad if i % 2 else "") + say()) for i in range(60)]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(spark.createDataFrame(new, "doc_id long, text string"), model).collect()}
    assert np.mean([got[1000 + i] == i % 2 for i in range(60)]) >= 0.95


def test_accents_and_long_words_fold(spark):
    assert toxicity.fold("Scüm ｓｃｕｍ ѕсum sçúm") == " scum scum scum scum "
    assert f" {'q' * 90} " in toxicity._terms(toxicity.fold("Q" * 90)) and " u " in toxicity._terms(toxicity.fold("u r"))


def test_lexicon_counts_and_hits(spark):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(60)] + ["vile", "rotten", "idiot", "trash"]
    rows = []
    for i in range(300):
        bad = i % 3 == 0
        t = [rng.choice(words[:60]) for _ in range(20)] + ([rng.choice(words[60:])] if bad or rng.random() < 0.02 else [])
        rows.append((i, " ".join(t), int(bad)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    lexicon, curve = toxicity.learn(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    bad, good = Counter(), Counter()
    texts = {(t, x) for _, t, x in rows}
    for t, x in texts:
        own = set(t.split())
        terms = {f" {w} " for w in own} | {" " + w[:n] for w in own if len(w) > 4 for n in (4, 5, 6) if len(w) > n}
        (bad if x else good).update(terms)
    size = Counter(x for _, x in texts)
    want = {f" {w} ": toxicity.BASE_WEIGHT for w in toxicity.BASE}
    for t, n in bad.items():
        ratio = math.log((n + 0.1) / (size[1] + 0.2)) - math.log((good[t] + 0.1) / (size[0] + 0.2))
        if n >= 4 and ratio >= 3:
            want[t] = round(min(6.0, ratio), 6)
    assert lexicon == pytest.approx(want)
    matcher = toxicity.Matcher(lexicon)
    for _, t, _ in rows[:80] + [(0, "trash can idiot", 0), (0, "rottenness", 0)]:
        folded = toxicity.fold(t)
        best = {}
        for term, w in lexicon.items():
            at = folded.find(term)
            while at >= 0:
                best[at] = max(w, best.get(at, 0))
                at = folded.find(term, at + 1)
        for e in toxicity.EXCEPTIONS:
            phrase = toxicity.fold(e)
            at = folded.find(phrase)
            while at >= 0:
                best = {p: w for p, w in best.items() if not at <= p < at + len(phrase) - 1}
                at = folded.find(phrase, at + 1)
        assert matcher.features(t)[0] == pytest.approx(sum(best.values()))


# --- decontamination -----------------------------------------------------------------------------
def test_short_items_and_blocks(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    items = [(i, say(rng.choice([12, 20]))) for i in range(30)] + [(90, "zorgon protocol"), (91, "Xyzzy"), (92, ""), (93, None), (5, "zorgon protocol")]
    docs = [(i, say(60)) for i in range(40)] + [(100, "a ZORGON protocol, here"), (101, "zorgon a protocol"), (102, "xyzzy!"), (103, None), (104, ""), (105, "w1 " * 50_000 + items[3][1])]
    for k in range(25):
        w = items[k][1].split()
        w[rng.randrange(len(w))] = "edited"
        docs.append((200 + k, f"{say(20)} {' '.join(w)} {say(20)}"))
    docs += docs[-3:]  # repeated rows
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"_d": F.lit("mine"), "share": F.lit(1), "_b": F.lit(2), "overlap": F.lit("x")})
    b = spark.createDataFrame(items, "item_id long, text string")
    whole = decontaminate.decontaminate(d, b)
    got = whole.collect()
    assert whole.columns == ["doc_id", "text", "_d", "share", "_b", "contaminated", "item_id", "overlap", "first_word", "last_word"]
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in docs)
    by = {r["doc_id"]: r for r in got}
    assert by[100]["item_id"] == 5 and (by[100]["first_word"], by[100]["last_word"]) == (1, 2) and by[102]["item_id"] == 91
    assert not by[101]["contaminated"] and not by[103]["contaminated"] and by[104]["overlap"] == 0
    # every edited copy, its place included, against the plain alignment with all items
    hashes = {i: word_hashes([t], ALNUM, lower=True)[0] for i, t in items if t and len(t.split()) > 2}
    for k in range(25):
        r = by[200 + k]
        h, _ = word_hashes([dict(docs)[200 + k]], ALNUM, lower=True)
        found = {i: decontaminate.align(x, h[None, :]) for i, x in hashes.items()}
        share, item = max((float(s[0]) / len(hashes[i]), -i) for i, (s, _, _) in found.items())
        assert (r["item_id"], r["overlap"]) == (-item, pytest.approx(share))
        assert (r["first_word"], r["last_word"]) == (found[-item][1][0], found[-item][2][0])
    split = decontaminate.decontaminate(d, b, block=4)
    assert sorted(map(str, split.select("doc_id", "contaminated", "item_id").collect())) == sorted(map(str, whole.select("doc_id", "contaminated", "item_id").collect()))


# --- top-k ---------------------------------------------------------------------------------------
def test_bounds_alone_find_the_best(spark, monkeypatch):
    rng = np.random.default_rng(5)
    for n in (2, 6, 40, 300, 2000):
        x = rng.integers(-200, 200, (n, 16))
        x[rng.integers(0, n, n // 4)] = x[0]
        block = topk.Block(x, np.arange(n), np.arange(n))
        owns = [0, n - 1, -1]
        queries = x[owns]
        got, kept = block.search(queries, owns, 5), block.candidates(queries, owns, 5)
        for q, own, best, places in zip(queries, owns, got, kept):
            others = np.flatnonzero(np.arange(n) != own)
            score = x[others] @ q
            want = [(int(others[i]), int(score[i])) for i in np.lexsort((others, -score))[:5]]
            assert best == want and set(p for p, _ in want) <= set(places.tolist()) and own not in places
        for end in {1, n // 2 + 1, n}:
            lower, upper = block.bounds(queries, end)
            exact = x @ queries.T
            assert (lower <= exact).all() and (exact <= upper).all() and (end < n or (lower == upper).all())
    huge = np.array([[2**61, 1], [2**61, 2], [3, 4]])
    assert len(topk.Block(huge, np.arange(3), np.arange(3)).candidates(huge[:1], [0], 1)[0]) == 2


# --- language ------------------------------------------------------------------------------------
def plain_buckets(text, buckets):
    """Buckets of all n-grams of one to three characters with a letter in them; what is not a letter is a space."""
    mask, bits, out = (1 << 64) - 1, buckets.bit_length() - 1, []
    codes = [ord(c) if c.isalpha() else 32 for c in (text or "").lower()]
    for i in range(len(codes)):
        g = 0
        for n in range(min(language.ORDERS, len(codes) - i)):
            g = (g * 0x9E3779B97F4A7C15 + codes[i + n] + n + 1) & mask
            if any(c != 32 for c in codes[i : i + n + 1]):
                h = g * 0xD6E8FEB86659FD93 & mask
                out.append(((h ^ h >> 32) * 0xD6E8FEB86659FD93 & mask) >> 64 - bits)
    return out


def test_language_is_naive_bayes(spark, sf_dir):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in table(spark, sf_dir, "documents").limit(60).collect()]
    rows += rows[:3] + [(900, "no language", None), (901, "12 34", "en"), (902, None, "de")]
    schema = "doc_id long, text string, lang string"
    names, matrix = language.learn(spark.createDataFrame(rows, schema))
    buckets = len(matrix) - 1
    counts, drawn = {}, Counter()
    for _, t, lang in rows:
        if lang and t and any(map(str.isalpha, t)):
            counts.setdefault(lang, Counter()).update(plain_buckets(t, buckets))
            drawn[lang] += 1
    assert names == sorted(counts)
    asked = [t for _, t, _ in rows[:25]] + ["", None, "99", "und die der", "x " * 3000]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(spark.createDataFrame(list(enumerate(asked * 2)), "doc_id long, text string"), (names, matrix)).collect()}
    for i, t in enumerate(asked):
        logs = {}
        for lang, c in counts.items():
            total = sum(c.values()) + language.SMOOTHING * buckets
            logs[lang] = math.log(drawn[lang] / sum(drawn.values())) + sum(math.log((c[b] + language.SMOOTHING) / total) for b in plain_buckets(t, buckets))
        best = max(logs, key=lambda x: (logs[x], x))
        want = (best, 1 / sum(math.exp(min(700.0, v - logs[best])) for v in logs.values())) if any(map(str.isalpha, t or "")) else ("und", 0.0)
        assert got[i][0] == want[0] and got[i][1] == pytest.approx(want[1], abs=1e-6) and got[i] == got[i + len(asked)]


# --- foreign columns -----------------------------------------------------------------------------
FOREIGN = ["score", "predicted", "contaminated", "item_id", "overlap", "first_word", "last_word", "target", "size", "source_size", "copies", "taken", "mix_key", "_b", "_t", "_id", "_src", "_d", "sid", "t", "ranges", "n", "columns.of"]


def test_pipeline_keeps_foreign_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (9001, "", None, "web", 0), (9002, None, "en", None, None), (9003, "the same words again and again here", "en", "web", 1), (9003, "the same words again and again here", "en", "web", 1)], rows.schema)
    docs = rows.unionByName(odd)
    wide = docs
    for i, c in enumerate(FOREIGN):
        wide = wide.withColumn(c, F.concat(F.lit(f"{i}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    plain, full = settle(docs, "test-plain"), settle(wide, "test-wide")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, full = settle(stage(spark, plain, sf_dir), "test-stage"), settle(stage(spark, full, sf_dir), "test-stage")
        assert full.columns == wide.columns and full.dtypes == wide.dtypes, name
        own = lambda df: sorted(map(str, df.select(*docs.columns).collect()))
        assert own(plain) == own(full), name
        for i, c in enumerate(FOREIGN):
            same = F.col(f"`{c}`") == F.concat(F.lit(f"{i}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
            assert full.filter(~same).count() == 0, (name, c)
    kept = full.select("doc_id").collect()
    assert sum(r[0] is None for r in kept) <= 1
    last = corpus_pipeline.STAGES[-1][1](spark, full, sf_dir)
    assert last.count() == len(kept)


def test_pipeline_of_an_empty_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, sf_dir), "test-stage")
    assert docs.count() == 0


def test_operators_keep_working_names(spark):
    df = spark.createDataFrame([(1, "mail a@b.cd now", 7, "x", "y", "z")], "doc_id long, text string, t int, ranges string, _spans string, _lic_text string")
    (a,) = substrings.dedup(df).collect()
    (b,) = pii.find(df).collect()
    (c,) = licenses.scan(df.withColumn("_lic_found", F.lit("w"))).collect()
    assert (a["t"], a["ranges"], a["n_words"]) == (7, "x", 3) and (b["_spans"], b["n_email"]) == ("y", 1) and (c["_lic_text"], c["_lic_found"], c["text"]) == ("z", "w", "mail a@b.cd now")


def test_working_tables_and_shuffles_of_the_join_go_with_their_last_reader(spark, sf_dir, tmp_path, monkeypatch):
    import random

    from wattloom.llm import jaccard
    from wattloom.llm.common import recorded, table

    table(spark, sf_dir, "documents")
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
    monkeypatch.setattr(jaccard, "GROUP", 4)  # a cluster of several parts
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    rows = [(k, " ".join([*base[:k], f"x{k}", *base[k + 1 :]])) for k in range(0, 60, 3)] + [(100 + k, " ".join(rng.choice(words) for _ in range(80))) for k in range(5)]
    with recorded() as paths:
        out = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"))
        got = {r.doc_id: r.component_id for r in out.collect()}
    assert {got[k] for k, _ in rows if k < 100} == {0} and all(got[k] == k for k, _ in rows if k >= 100)
    fs = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    left = [p.rpartition("/")[2] for p in paths if fs(p).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p))]
    made = [p.rpartition("/")[2] for p in paths]
    assert sum(p.startswith("jaccard-lists") for p in made) == 3 and sum(p.startswith("jaccard-lists") for p in left) == 1
    assert any(p.startswith("jaccard-tokens") for p in made) and not any(p.startswith("jaccard-tokens") for p in left)
    assert sum(p.startswith("jaccard-entries") for p in left) <= 1
