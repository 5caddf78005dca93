"""Every training-data operator against a plain version: nulls, empty and long texts, ties and repeats, empty tables, clashing names."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from wattloom.llm import decontaminate, jaccard, language, licenses, mixing, pii, substrings, tokens, topk, toxicity
from wattloom.llm.common import table
from wattloom.llm.words import NO_SPACE, grams, word_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = " ".join(f"p{i}" for i in range(60))


def corpus():
    """Rows with nulls in every column, odd spaces, repeats, near copies, shared passages and a long text."""
    rng = random.Random(7)
    vocabulary = ["wen", "tha", "Ron", "lé", "der", "oui", "zwölf", "niño"] + [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        t = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 120])))
        rows.append((i, t, "abc"[i % 3] * 2, f"s{i % 4}", len(t)))
    base = " ".join(rng.choice(vocabulary) for _ in range(100))
    rows.append((100, base, "aa", "s0", 1))
    for k in range(25):  # near copies, some too far from each other
        w = base.split()
        for _ in range(k % 4):
            w[rng.randrange(100)] = f"edit{k}"
        rows.append((101 + k, " ".join(w), "aa", "s0", 1))
    rows += [(200 + k, base.upper() if k % 2 else base, None, None, None) for k in range(5)]
    rows += [(300, None, "aa", "s1", 0), (301, "", "aa", "s1", 0), (302, " \t\n", None, "s1", 3), (303, "one", "aa", "s9", 3), (304, "one", "aa", "s9", 3), (304, "one", "aa", "s9", 3)]
    rows += [(None, "x " + PASSAGE + " y", "aa", "s2", 5), (None, None, None, None, None), (400, PASSAGE, "bb", "s2", 5), (401, "q " * 2000 + PASSAGE + "\n" + PASSAGE, "bb", None, 5)]
    rows += [(402, "a@b.c_d@e.f 256.1.1.1 1.2.3.4.5.6.7.8 4111 1111 1111 1111 +1 (988) 555-2485 😀 4111-1111-1111-1112", "cc", "s2", 5)]
    rows += [(403, "CC.\nby all rights reserved; General-Public license 😀cc by, İ cc by", "cc", "s2", 5), (404, "1" * 30_000 + " " + "a." * 20_000 + "@", "cc", "s2", 5), (405, " " * 50_000 + "z" * 50_000, "cc", "s2", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    table(spark, "/root/testdata/sf0.001", "documents")
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def pairs():
    return [(r[0], r[1]) for r in corpus()]


def bag(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_jaccard_components(docs, pairs):
    assert bag(jaccard.join(docs).collect()) == bag(brute.components(pairs))


def test_jaccard_keeps_one_of_each(docs, pairs):
    kept = jaccard.one_of_each(docs.withColumn("_t", F.lit("mine")))
    assert kept.columns == [*docs.columns, "_t"]
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    component = {p: c for p, (_, _, c) in zip(pairs, brute.components(pairs))}
    filled = [p for p in got if brute.words(p[1])]
    groups = [component[p] for p in filled if component[p] is not None]
    assert len(set(groups)) == len(groups)
    assert set(groups) == {c for (d, t), c in component.items() if brute.words(t) and c is not None}
    assert all(d == component[d, t] for d, t in filled if component[d, t] is not None)
    assert sum(1 for p in got if not brute.words(p[1])) == sum(1 for p in pairs if not brute.words(p[1]))


def test_jaccard_group_answers():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(100, 190), replace=False), rng.integers(0, 2**63, rng.integers(0, 40)).astype(np.uint64)])) for _ in range(40)]
    for i, c in enumerate(jaccard.shared_counts(sets)):
        assert c.tolist() == [len(np.intersect1d(sets[i], s)) for s in sets]


def test_jaccard_small_groups_lose_nothing(spark, docs, pairs, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP", 2)
    assert bag(jaccard.join(docs).collect()) == bag(brute.components(pairs))


def test_jaccard_sets_left_apart_meet_in_bounded_groups(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for _ in range(2):  # two families of near copies that share one list entry
        base = [word() for _ in range(70)]
        for k in range(60):
            copy = list(base)
            copy[rng.randrange(70)] = word()
            texts.append(" ".join(copy) + (" link one two three four" if k == 0 else ""))
    chain = [word() for _ in range(400)]
    texts += [" ".join(chain[5 * k : 5 * k + 70]) for k in range(60)]  # each is similar to the next, none to many
    pairs = list(enumerate(texts))
    groups, decided = [], jaccard._decided

    def counted(dealt, sets):
        groups.append([r["count"] for r in dealt.groupBy("cluster", "part").count().collect()])
        return decided(dealt, sets)

    monkeypatch.setattr(jaccard, "GROUP", 8)
    monkeypatch.setattr(jaccard, "_decided", counted)
    assert bag(jaccard.join(spark.createDataFrame(pairs, "doc_id long, text string")).collect()) == bag(brute.components(pairs))
    assert len(groups) == 3 and groups[2] and max(groups[2]) <= 4 * jaccard.GROUP


def test_substrings(docs, pairs):
    got = substrings.dedup(docs.select("doc_id", "text", F.lit("x").alias("ranges_"), F.lit(1).alias("n_words")))
    assert bag(got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == bag(brute.removed(pairs))


def test_pii(docs, pairs):
    got = pii.find(docs.withColumn("spans", F.lit(0)))
    want = [(d, *brute.personal(t)[0]) for d, t in pairs]
    assert bag(got.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect()) == bag(want)
    shown = {r["doc_id"]: set(r["spans"].split(",")) for r in got.collect()}
    assert all(set(filter(None, brute.personal(t)[1].split(","))) <= shown[d] for d, t in pairs if d is not None and d != 304)


IBANS = [
    "DE89370400440532013000", "FR1420041010050500013M02606", "ES9121000418450200051332", "GB29NWBK60161331926819", "IT60X0542811101000000123456", "NL91ABNA0417164300",
    "BE68539007547034", "CH9300762011623852957", "AT611904300234573201", "PL61109010140000071219812874", "SE4550000000058398257466", "DK5000400440116243", "NO9386011117947",
    "FI2112345600000785", "IE29AIBK93115212345678", "PT50000201231234567890154", "LU280019400644750000", "CZ6508000000192000145399",
]


def test_pii_whole_ibans_and_long_secrets(spark):
    spaced = [" ".join(x[i : i + 4] for i in range(0, len(x), 4)) for x in IBANS]
    secrets = ["token=" + "a1" * 150, "secret: " + "7" * 100_000, "password=" + "a" * 100_000]
    found = [*IBANS, *spaced, *secrets]
    rows = spark.createDataFrame([(i, f"account {x} EUR 500 THIS YEAR") for i, x in enumerate(found)], "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"], s["gazetteer"]) for s in r["_spans"] if not s["base"]] for r in pii.candidates(rows).collect()}
    n, iban, secret = len(IBANS), pii.KINDS.index("iban"), pii.KINDS.index("secret")
    for i, x in enumerate(found):
        assert (iban if i < 2 * n else secret, 8, 8 + len(x), -1 if i == len(found) - 1 else 1) in got[i], x
    assert {x[:2] for x in IBANS} == set(pii.GOOD["iban"][4:-1].split("|"))


def test_pii_estimates():
    cells = [{"kind": 0, "regex": 1, "gazetteer": 1, "context": 1, "size": 1, "n": 90}, {"kind": 0, "regex": -1, "gazetteer": -1, "context": 0, "size": 1, "n": 30}]
    p = pii.estimate(cells)
    assert p[0] > 0.9 and p[1] < 0.2
    w = pii.train(cells, p)
    assert sum(w[f] for f in pii._names(cells[0])) > 0 > sum(w[f] for f in pii._names(cells[1]))


def test_licenses(docs, pairs):
    got = licenses.scan(docs.withColumn("labels", F.lit(0)))
    want = [(d, *brute.phrases(t, licenses.BASE)) for d, t in pairs]
    assert bag(got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()) == bag(want)


def test_license_rules(spark):
    texts = ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: MIT", "GNU General Public License, version 3", "see apache.org", "Licensed under CC BY-NC 4.0."]
    got = [r["labels"] for r in licenses.scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["apache-2.0", "mit", "gpl,gpl-3.0", "", "cc-by,cc-by-nc-4.0"]
    assert len(licenses.rules()) > 200


def _written(pattern):
    """Texts that a pattern matches: all its branches and options, with line ends as white space."""

    def texts(items):
        out = [""]
        for op, x in items:
            op = str(op)
            if op == "LITERAL":
                own = [chr(x)]
            elif op == "IN":
                own = [{"CATEGORY_SPACE": "\n", "CATEGORY_NOT_SPACE": "x"}[str(v)] if str(o) == "CATEGORY" else chr(v[0] if str(o) == "RANGE" else v) for o, v in x]
            elif op == "BRANCH":
                own = [t for y in x[1] for t in texts(y)]
            elif op == "SUBPATTERN":
                own = texts(x[3])
            elif op == "MAX_REPEAT":
                own = [t * max(1, x[0]) for t in texts(x[2])] + [""] * (x[0] == 0)
            else:
                assert op == "ASSERT_NOT", op
                own = [""]
            out = [a + b for a in out for b in own]
        return out

    return texts(re._parser.parse(pattern))


def test_license_keywords_stand_in_every_match(spark):
    chosen = []
    for label, keys, pattern, _ in licenses.rules():
        texts = _written(pattern)
        assert all(any(k in t.lower() for k in keys.split()) and any(g in t.lower() for g in licenses.GATES) for t in texts), (label, pattern)
        chosen += [(label, texts[i]) for i in sorted({0, len(texts) // 3, len(texts) // 2, len(texts) - 1})]
    chosen += [("cc-by-4.0", "Creative Commons Attribution 4.0"), ("public-domain", "placed in the public\n domain"), ("warranty-disclaimer", "provided 'as  is'"), ("wtfpl", "www.wtfpl.net")]
    rows = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(chosen)], "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r for r in licenses.scan(rows).collect()}
    lost = [(x, got[i]["labels"]) for i, x in enumerate(chosen) if not got[i]["score"] or x[0] not in got[i]["labels"].split(",")]
    assert not lost


def test_packing():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 1023, 1024, 1025, 20_000):
        for most in (0, 1, 50_000, 2**32 - 1):
            x = rng.integers(0, most, n, dtype=np.uint32, endpoint=True)
            blocks, starts = tokens.pack(x)
            assert (tokens.unpack(blocks, starts) == x).all() and len(starts) == -(-n // tokens.BLOCK)


ODD = ["  a  b \n c\t d  ", "", " ", "\n\n x", "　y", "a \x1c b\x85  c  'll  don't  12 3", "x\0 y \0z\n\0", "\n", "\0", "end\n", "\t\tfoo x", "a\n\t\tfoo b", "q \t\tfoo", "a.\nb,\nc . , x.,", "<|endoftext|> z"]


def test_encoder_equals_whole_texts(pairs):
    with open(tokens.default_tokenizer(), encoding="utf-8") as f:
        e = tokens.Encoder(f.read())
    texts = [t or "" for _, t in pairs] + ODD
    assert e.by_word
    for _ in range(2):
        assert [x.tobytes() for x in e.encode(texts)] == e._ids(texts)


def test_added_tokens_keep_their_ids(spark):
    import tokenizers

    t = tokenizers.Tokenizer.from_file(tokens.default_tokenizer())
    plain = [*ODD, "<|endoftext|>", "a<|endoftext|>b  c\n<|endoftext|>", "<|endoftext |>"]
    want = [t.encode(x, add_special_tokens=False).ids for x in plain]
    rows = spark.createDataFrame(list(enumerate(plain)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in tokens.read_ids(tokens.write_tokens(rows, shards=2)).collect()}
    assert [got[i][:-1] for i in range(len(plain))] == want and 50256 in got[len(ODD)]
    # added tokens with a space in them, or of ordinary letters
    for more, by_word in ((tokenizers.AddedToken("x y", normalized=False), False), (tokenizers.AddedToken("ship", normalized=False), True)):
        t.add_tokens([more])
        e = tokens.Encoder(t.to_str())
        texts = ["a x y b", "x", "y", "some ships, a ship", "nothing", "shi p"]
        assert [x.tolist() for x in e.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
        t = tokenizers.Tokenizer.from_file(tokens.default_tokenizer())
        assert e.by_word == by_word


def test_tokens(spark, docs, pairs):
    import tokenizers

    t = tokenizers.Tokenizer.from_file(tokens.default_tokenizer())
    written = tokens.write_tokens(docs, shards=4)
    got = tokens.read_digests(written).collect()
    order = sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0, p[1] is not None, (p[1] or "").encode()))
    want, start = [], 0
    for d, text in order:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert {r["doc_id"]: r["ids"] for r in tokens.read_ids(written).collect()}[303] == [*t.encode("one", add_special_tokens=False).ids, 2]
    assert tokens.read_digests(tokens.write_tokens(empty(spark))).count() == 0


def test_mixing_follows_budgets(docs):
    out = mixing.mix(mixing.with_keys(docs.withColumn("target", F.lit("mine"))))
    rows = out.collect()
    assert len(rows) == docs.count() and all(r["size"] == len(brute.words(r["text"])) and r["taken"] <= 2 * r["size"] for r in rows)
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        assert all(r["source_size"] == sum(x["size"] for x in own) for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    again = mixing.mix(mixing.with_keys(docs.repartition(7))).select("doc_id", "taken").collect()
    assert bag(again) == bag((r["doc_id"], r["taken"]) for r in rows)


def test_mixing_buckets_change_nothing(docs, monkeypatch):
    keyed = mixing.with_keys(docs)
    whole = bag(mixing.mix(keyed).select("doc_id", "taken").collect())
    monkeypatch.setattr(mixing, "BUCKET", 3)
    assert bag(mixing.mix(keyed).select("doc_id", "taken").collect()) == whole


def test_targets_reshare(spark):
    sizes = spark.createDataFrame([("a", 10, 1), ("b", 1000, 1), ("c", 0, 1), (None, 500, 1)], "source string, source_size long, _n long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    want, open_, left = {}, {"a": (5, 20), "b": (2, 2000), "c": (1, 0), None: (5, 1000)}, 2265.0
    while open_:
        level = left / sum(w for w, _ in open_.values())
        full = {s: c for s, (w, c) in open_.items() if w * level > c}
        for s, c in full.items():
            want[s], left = float(c), left - c
            del open_[s]
        if not full:
            want.update({s: w * level for s, (w, _) in open_.items()})
            break
    assert got == pytest.approx(want)


def test_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = language.held_out(F.col("doc_id"), 5, 0)
    model = language.learn(docs.filter(~held))
    rows = language.predict(docs.filter(held).withColumn("score", F.lit("mine")), model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.9 and all(0 <= r["score"] <= 1 for r in rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !"), (None, "x"), (4, "die und " * 100_000)], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] in model[0] and got[None][0] in model[0]
    nothing = language.learn(empty(spark))
    assert language.predict(odd, nothing).filter("lang_pred <> 'und'").count() == 0


def test_language_pieces_change_nothing(spark, sf_dir, monkeypatch):
    docs = table(spark, sf_dir, "documents").limit(40)
    model = language.learn(docs)
    x = [t for (t,) in docs.select("text").collect()]

    def counts(limit):
        out = np.zeros((len(x), len(model[1]) - 1), int)
        for run in language._runs(x, limit):
            found, text = language._placed(run, len(model[1]) - 1)
            np.add.at(out, (text, found), 1)
        return out

    assert (counts(50) == counts(1 << 17)).all()


def test_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held = language.held_out(F.col("doc_id"), 4, 2)
    model = toxicity.learn(docs, labels.filter(~held))
    rows = toxicity.score(docs, model).join(labels.filter(held), "doc_id").filter("toxic is not null").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) >= 0.9
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "calm " * 100_000)], "doc_id long, text string").withColumn("predicted", F.lit("mine"))
    assert all(r["predicted"] == 0 and 0 <= r["score"] <= 1 for r in toxicity.score(odd, model).collect())
    assert toxicity.learn(empty(spark).select("doc_id", "text"), labels.limit(0))[1] == toxicity.BASE_CURVE


def test_toxic_folding():
    m = toxicity.Matcher({" idiot ": 4.0, " trash ": 4.0, " tra": 1.0})
    assert m.features("an 1d10t, а ТRΑSН")[0] == 8.0 and m.features("an 1d10t")[0] == 4.0
    assert m.features("the trash can")[0] == 0.0 and m.features("trash talk")[0] == 4.0 and m.features("tram")[0] == 1.0 and m.features(None) == (0.0, 0)


def test_decontamination(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    rng = random.Random(2)
    rows, want = [], {}
    for n, (i, t) in enumerate(items.select("item_id", "text").collect()):
        w = t.split()
        edited = [x if rng.random() > 0.1 else rng.choice(["zz", ""]) for x in w]
        rows += [(3 * n, "lead in " + t + " out"), (3 * n + 1, "lead " + " ".join(edited)), (3 * n + 2, " ".join(f"q{rng.randrange(99)}" for _ in range(60)))]
        want[3 * n] = i
    rows += [(-1, None), (-2, ""), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("mine"))
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, items).collect()}
    assert all(got[d]["contaminated"] and got[d]["overlap"] == 1.0 for d in want)
    assert not any(got[d]["contaminated"] for d in got if d is None or d < 0 or d % 3 == 2)
    index = decontaminate.Index([r["item_id"] for r in items.collect()], [r["text"] for r in items.collect()])
    for d, t in rows:
        if d is not None and d >= 0 and d % 3 == 1:  # alignment of the whole text with every item
            h, _ = word_hashes([t], decontaminate.ALNUM, lower=True)
            best = max(decontaminate.align(x, h[None, :])[0][0] / len(x) for x in index.items)
            assert got[d]["contaminated"] == (best >= decontaminate.THRESHOLD)
    split = decontaminate.decontaminate(docs, items, block=7).select("doc_id", "contaminated", "item_id", "overlap").collect()
    assert bag(split) == bag((r["doc_id"], r["contaminated"], r["item_id"], r["overlap"]) for r in got.values())
    assert decontaminate.decontaminate(docs, items.limit(0)).filter("contaminated").count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 0.2, (3000, 16)).astype(np.float32)
    x[100:900] = x[100]  # ties
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(len(x))] + [(100, [float(v) for v in x[100]], 2), (5000, None, 1), (5001, [1.0, None], 1), (5002, [float("nan")] * 16, 1), (5050, [float("inf")] * 16, 1), (5100, [1.0, 2.0], 1), (None, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = topk.top_k(topk.vectors(df), F.col("vec_id") % 50 == 0, block=700).collect()
    v = np.floor(256 * x.astype(float)).astype(np.int64)
    v, ids = np.vstack([v, v[100]]), [*range(3000), 100]
    want = []
    for q, i in enumerate(ids):
        if i % 50 == 0:
            s = v @ v[q]
            order = [p for p in sorted(range(len(ids)), key=lambda p: (-s[p], ids[p])) if p != q][:5]
            want += [(i, r + 1, ids[p], int(s[p])) for r, p in enumerate(order)]
    assert bag(got) == bag(want)
    assert topk.top_k(topk.vectors(df.limit(0)), F.col("vec_id") % 50 == 0).count() == 0


def test_word_hashes_are_words(pairs, monkeypatch):
    texts = [t for _, t in pairs]
    whole = word_hashes(texts)
    monkeypatch.setattr("wattloom.llm.words.PIECE", 100)
    cut = word_hashes(texts)
    assert (whole[0] == cut[0]).all() and whole[1].tolist() == cut[1].tolist() == [0, *np.cumsum([len(brute.words(t)) for t in texts])]
    assert len(grams(*word_hashes(["a b", "c d e"], NO_SPACE), 2)[0]) == 3


def test_empty_tables(spark):
    none = empty(spark)
    assert jaccard.join(none).count() == jaccard.one_of_each(none).count() == substrings.dedup(none).count() == pii.find(none).count() == licenses.scan(none).count() == 0
    assert mixing.mix(mixing.with_keys(none)).count() == 0
