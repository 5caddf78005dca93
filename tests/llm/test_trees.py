"""Prefix trie, Merkle manifest and improbable-feature digests against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from wattloom.llm import fingerprints, merkle, tries
from wattloom.llm.common import table

TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


@pytest.fixture(autouse=True)
def settings(spark, sf_dir):
    table(spark, sf_dir, "documents")


# --- trie ----------------------------------------------------------------------------------------
def plain_trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((t is not None, t or 0, sha(f"{len(role.encode())}:{role}{text}"), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:])
    nodes = defaultdict(list)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            nodes[s[:d]].append(c)
    children = Counter(s[:-1] for s in nodes if s)
    saved, leaves = Counter(), Counter()
    for s, members in nodes.items():
        words = (len(members) - 1) * len(brute.words(s[-1][1])) if s else 0
        for d in range(len(s) + 1):
            saved[s[:d]] += words
            leaves[s[:d]] += not children[s]
    out = []
    for s, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if whole[c] == s)
        out.append((min(members), len(s), min(nodes[s[:-1]]) if s else None, len(members), children[s], leaves[s], saved[s], sha(ends)))
    return sorted(out)


def conversations():
    rng = random.Random(11)
    rows = []
    for c in [*range(-45, 130), 10**15]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, t, rng.choice(["user", "bot"]), rng.choice(["hello there", "a b c", "x", ""])))
    rows += [(200, t, "user", f"turn {t % 3} of many") for t in range(70)] + [(201, t, "user", f"turn {t % 3} of many") for t in range(67)]  # a chain
    rows += [(1000 + i, 0, "user", "the same") for i in range(300)]  # copies
    rows += [(300, None, None, None), (300, None, "user", None), (300, 1, "", ""), (300, 1, "", ""), (300, 1, "z", "a"), (None, 1, "user", "of nobody")]
    return rows


def test_trie(spark, monkeypatch):
    rows = conversations()
    df = spark.createDataFrame(rows, TURNS).withColumns({"name": F.lit("mine"), "depth": F.lit(1), "parent": F.lit(2), "place": F.lit(3), "length": F.lit(4), "_h": F.lit(5)})
    assert sorted(map(tuple, tries.conversation_trie(df.repartition(5)).collect())) == plain_trie(rows)
    monkeypatch.setattr(tries, "CHUNK", 7)  # lists of ids in many pieces
    assert sorted(map(tuple, tries.conversation_trie(df).collect())) == plain_trie(rows)


def test_trie_of_turnless_conversations(spark):
    # crc32 of these ids leaves a remainder of 1 or more, and no conversation begins their family
    ids = [c for c in range(1, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 1][:5]
    rows = [(c, 0, "user", "gone") for c in ids]
    got = sorted(map(tuple, tries.conversation_trie(spark.createDataFrame(rows, TURNS)).collect()))
    assert got == plain_trie(rows) and len(got) == 1 and got[0][5] == 1
    assert tries.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0


def test_trie_of_long_texts(spark):
    rows = [(20, 0, "user", "word " * 200_000), (21, 0, "user", "word " * 200_000), (22, 0, "user", "word " * 199_999)]
    assert sorted(map(tuple, tries.conversation_trie(spark.createDataFrame(rows, TURNS)).collect())) == plain_trie(rows)


# --- Merkle manifest -----------------------------------------------------------------------------
def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        out.append((i ^ 1 < len(level) and level[i ^ 1], i % 2))
        i //= 2
    return out


def plain_manifest(rows):
    """rows: doc_id, text, lang, source, n_chars."""
    groups = defaultdict(list)
    for d, text, lang, source, n in rows:
        tampered = d is not None and zlib.crc32(str(d).encode()) % 7 == 0
        more = n + 1 if tampered and n is not None else n
        groups["-" if lang is None else "=" + lang].append((d is not None, d or 0, plain_leaf((d, source, lang, n, text)), plain_leaf((d, source, lang, more, text)), d))
    trees = {g: plain_levels([x[2] for x in sorted(v)]) for g, v in groups.items()}
    names = sorted(trees, key=lambda g: g.encode())
    top = plain_levels([trees[g][-1][0] for g in names])
    root, out = top[-1][0], []
    for g in names:
        for i, (_, _, leaf, changed, d) in enumerate(sorted(groups[g])):
            way = siblings(trees[g], i) + siblings(top, names.index(g))
            at = changed
            for s, right in way:
                at = sha((s + at if right else at + s) if s else at)
            out.append((d, leaf, trees[g][-1][0], root, sha("".join(s for s, _ in way if s)), at, at == root))
    return out


def documents():
    rng = random.Random(5)
    rows = [(i, f"text {rng.random()} é", rng.choice(["en", "en", "en", "de", "", "éa", "z😀", None]), rng.choice(["s", None]), rng.choice([None, 4, 10**18])) for i in range(400)]
    rows += [(500, "lone", "lone", "s", 1), (None, "x", "en", "s", 2), (None, None, None, None, None), (7, "again", "en", "s", 3), (7, "again", "en", "s", 3), (7, "", "en", "", 0)]
    return rows + [(501, "long " * 100_000, "de", "s", 500_000)]


@pytest.mark.parametrize("levels", [12, 3, 1])
def test_manifest(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = documents()
    df = spark.createDataFrame(rows, DOCS).withColumns({"leaf": F.lit("mine"), "grp": F.lit("x"), "position": F.lit(1), "changed": F.lit("y"), "root": F.lit(0)})
    got = []
    # the blocks run in Python workers, which take the level from the module's setting at the time the function is sent
    for r in _manifest(df.repartition(4), levels).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect():
        got.append(tuple(r))
    assert sorted(got, key=repr) == sorted(plain_manifest(rows), key=repr)


def _manifest(df, levels):
    return merkle.manifest(df, F.crc32(F.col("doc_id").cast("string")) % 7 == 0, levels)


def test_manifest_of_few_rows(spark):
    assert _manifest(spark.createDataFrame([], DOCS), 12).count() == 0
    (r,) = _manifest(spark.createDataFrame([(1, "a", "en", "s", 1)], DOCS), 12).collect()
    assert r["root"] == r["subroot"] == r["leaf"] == plain_leaf((1, "s", "en", 1, "a")) and r["proof_sha256"] == sha("")


def test_versions_copy_ancestors_only():
    nodes = [sha(str(i)) for i in range(13)]
    tree = merkle.Tree(nodes, 4)
    before = (list(tree.digest), list(tree.left), list(tree.right))
    for place in range(13):
        first = len(tree.digest)
        version = tree.put(place, sha("other"))
        changed = list(nodes)
        changed[place] = sha("other")
        assert tree.digest[version] == plain_levels(changed)[-1][0]
        assert len(tree.digest) - first == 5  # the leaf and its four ancestors; everything else is shared
        assert merkle.climb(sha("other"), tree.path(place))[-1] == tree.digest[version]
    assert [x[: len(before[0])] for x in (tree.digest, tree.left, tree.right)] == list(before)


def test_copied_nodes_lead_to_the_root(spark):
    rows = documents()
    for r in _manifest(spark.createDataFrame(rows, DOCS), 3).filter("size(copied) > 0").collect():
        assert r["copied"][-1] == r["folded_root"] != r["root"] and not r["verified"]


# --- fingerprints --------------------------------------------------------------------------------
def plain_level(window):
    total = sum(int(np.rint(c * math.log2(c) * (1 << 20))) for c in Counter(window).values())
    full = int(np.rint(64 * 6 * (1 << 20)))
    return (full - total) * 1000 // full


def plain_hash(window):
    mask, h = (1 << 64) - 1, 0
    for k, m in enumerate(int(x) for x in fingerprints._MIX):
        h = (h ^ int.from_bytes(window[8 * k : 8 * k + 8], "little")) * m & mask
        h ^= h >> 29
    h = h * int(fingerprints._MIX[0]) & mask
    return h ^ h >> 32


def plain_digest(text, rank):
    b = text.encode()
    if not b:
        return b""
    if len(b) < 64:
        found = [int.from_bytes(hashlib.sha256(b).digest()[:8], "little")]
    else:
        windows = [b[i : i + 64] for i in range(len(b) - 63)]
        order = [rank[plain_level(w)] for w in windows]
        popular = Counter()
        for begin in range(-63, len(windows)):
            run = range(max(0, begin), min(len(windows), begin + 64))
            popular[min(run, key=lambda i: (order[i], i))] += 1
        found = list(dict.fromkeys(plain_hash(w) for i, w in enumerate(windows) if popular[i] >= 16))
    out = b""
    for begin in range(0, len(found), 160):
        bits = [0] * 2048
        for h in found[begin : begin + 160]:
            for k in range(5):
                bits[h >> 11 * k & 2047] = 1
        out += bytes([len(found[begin : begin + 160])]) + int("".join(map(str, bits)), 2).to_bytes(256, "big")
    return out


def plain_likeness(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    if (len(a), a) > (len(b), b):
        a, b = b, a
    split = lambda d: [(d[i], int.from_bytes(d[i + 1 : i + 257], "big")) for i in range(0, len(d), 257)]
    total = weight = 0
    for n, x in split(a):
        best = 0.0
        for _, y in split(b):
            chance = x.bit_count() * y.bit_count() / 2048
            room = max(min(x.bit_count(), y.bit_count()) - chance, 1e-9)
            best = max(best, ((x & y).bit_count() - chance) / room)
        total += n * (0 if best < 0.1 else min(best, 1.0))
        weight += n
    return total / weight


def prints():
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice(["wen", "thé", "Ron", "der", "zwölf", f"w{rng.randrange(999)}"]) for _ in range(n))
    rows = [(i, say(rng.choice([1, 5, 12, 13, 14, 40, 200]))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "a" * 500), (103, "short"), (104, "short"), (104, "short"), (None, "no id"), (None, None), (105, "😀" * 40), (106, say(3000)), (107, "ab" * 31), (108, "ab" * 32)]
    return rows


def plain_fingerprints(rows, rank):
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    out = []
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        a, b = plain_digest(t, rank), plain_digest(e, rank)
        out.append((d, len(t), sha(e), a, b, round(plain_likeness(a, b), 6), round(plain_likeness(a, plain_digest(nxt, rank)), 6)))
    return sorted(out, key=repr)


def shown(rows):
    f = fingerprints.fingerprint_bytes
    return sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], f(r["fingerprint"]), f(r["edited_fingerprint"]), round(r["near_edited"], 6), round(r["near_next"], 6)) for r in rows), key=repr)


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_fingerprints(spark, shards):
    rows = prints()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"shard": F.lit("x"), "place": F.lit(1), "digest": F.lit(2), "_text": F.lit(3)})
    rank = fingerprints.entropy_ranks(df)
    windows = [t.encode()[i : i + 64] for _, t in rows for i in range(len((t or "").encode()) - 63)]
    counts = Counter(map(plain_level, windows))
    want = {e: i for i, e in enumerate(sorted(range(1001), key=lambda e: (e < 100, counts[e], -e)))}
    assert [want[e] for e in range(1001)] == rank.tolist()
    assert shown(fingerprints.fingerprints(df.repartition(5), shards).collect()) == plain_fingerprints(rows, want)


def test_fingerprints_of_few_rows(spark):
    schema = "doc_id long, text string"
    assert fingerprints.fingerprints(spark.createDataFrame([], schema)).count() == 0
    text = "one document alone, which is its own next one, of more than a window of bytes"
    (r,) = fingerprints.fingerprints(spark.createDataFrame([(1, text)], schema)).collect()
    assert r["near_next"] == 1.0 and r["n_chars"] == len(text)


def test_parts_of_long_texts_change_nothing(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh é\n") for _ in range(9000))
    rank = fingerprints.ranks(fingerprints.level_counts([text.encode()]))
    whole, counts = fingerprints.digests([text], rank), fingerprints.level_counts([text.encode()])
    monkeypatch.setattr(fingerprints, "BATCH", 700)
    assert fingerprints.digests([text], rank) == whole and (fingerprints.level_counts([text.encode()]) == counts).all()


def test_likeness_follows_shared_text():
    rng = random.Random(4)
    say = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    base, other = say(2000), say(2000)
    rank = fingerprints.ranks(fingerprints.level_counts([base.encode(), other.encode()]))
    near = base.replace(base.split()[700], "changed")
    a, b, c, d = fingerprints.digests([base, near, other, fingerprints.edited(base, other)], rank)
    assert fingerprints.likeness(a, a) == 1 and fingerprints.likeness(a, b) > 0.9 and fingerprints.likeness(a, c) < 0.05
    assert 0.4 < fingerprints.likeness(a, d) < 0.65 and fingerprints.likeness(a, d) == fingerprints.likeness(d, a)
