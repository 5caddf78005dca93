"""Prefix trie of conversations by van Emde Boas recursion: how much of their beginnings conversations share.

Sequences of turns are cut at half of a height that no sequence reaches. The prefixes up to the cut get names, by which the remainders fall into forests; the
part above the cut and the forests below it are cut again in the same way, all of one height in parallel, until parts of BLOCK turns are left, whose few
prefixes are named one after the other. Then every prefix of every sequence has a name, and equal prefixes have equal ones. Totals of subtrees go the other
way: inside the blocks first, then at every height the sums of the trees below a cut are grafted onto the nodes above it, up to the root.

A name is 128 bits of a digest of the name before the cut and of the turns behind it; digests of aligned runs of blocks come from doubling. So a prefix is named without
gathering a sequence, a name's holders are only counted, and a sequence of d turns takes about log2(d / BLOCK) rounds of small joins by (conversation, block).

Defined results: a null role or text is empty. Turns stand in the order of their numbers, null first, equal ones in the order of their digests, so a repeated
row is a turn of its own. Rows with a null conversation id belong to none and are left out. An empty table has no conversations and no nodes. Texts of any
length become digests and word counts before anything is moved. Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import settle, word_count
from wattloom.operators.ranking import placed_rows
from wattloom.operators.skew import salted_join

FAMILY, HEADS = 20, 4  # conversations c - c % FAMILY .. share a beginning of fewer than HEADS turns
BLOCK = 16  # turns that are not cut any more
CHUNK = 8192  # ids of one piece of a list of ids
ROOT = "root"
EMPTY = hashlib.sha256(b"").hexdigest()


def _sha(*parts: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def _root() -> Column:
    return F.substring(F.unhex(F.sha2(F.lit(ROOT), 256)), 1, 16)


def symbols(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), symbol of the turn's role and text, and the words of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", _sha(F.octet_length(role).cast("string"), F.lit(":"), role, text).alias("symbol"), word_count(text).alias("words")
    )
    placed = placed_rows(turns, ["conv_id"], [F.col("turn"), F.col("symbol")])
    return settle(placed.select("conv_id", F.col("position").alias("place"), "symbol", "words"), "trie-turns")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of all conversations with the beginnings that their families share, and every conversation's length."""
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = F.crc32(F.col("conv_id").cast("string")) % HEADS
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n")).select("conv_id", "_n", first.alias("_first"), heads.alias("_h"))
    head = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("place") < HEADS - 1)).withColumnRenamed("conv_id", "_first")
    have = head.groupBy("_first").agg(F.count(F.lit(1)).alias("_have"))
    # a conversation takes at most HEADS - 1 turns, and at most 2 * FAMILY - 1 conversations take those of one
    convs = convs.join(have, "_first", "left").withColumn("_k", F.least("_h", F.coalesce("_have", F.lit(0))))
    convs = settle(convs.select("conv_id", "_n", "_first", "_h", "_k"), "trie-conversations")
    taken = convs.join(head, "_first").filter(F.col("place") < F.col("_k")).select("conv_id", "place", "symbol", "words")
    own = salted_join(turns, convs.select("conv_id", "_h", "_k"), ["conv_id"]).filter(F.col("place") >= F.col("_h"))
    own = own.select("conv_id", (F.col("place") - F.col("_h") + F.col("_k")).alias("place"), "symbol", "words")
    length = F.col("_k") + F.greatest(F.col("_n") - F.col("_h"), F.lit(0))
    return settle(taken.unionByName(own), "trie-rebuilt"), settle(convs.select("conv_id", length.cast("long").alias("length")), "trie-lengths")


def blocks(turns: DataFrame) -> DataFrame:
    """conv_id, block, and the symbols and words of its turns in their order: at most BLOCK."""
    turn = F.struct("place", "symbol", "words")
    gathered = turns.groupBy("conv_id", F.floor(F.col("place") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(turn)).alias("_t"))
    return settle(gathered.select("conv_id", "block", F.col("_t.symbol").alias("symbols"), F.col("_t.words").alias("words")), "trie-blocks")


def _runs(cut: DataFrame, height: int) -> list[DataFrame]:
    """Digests of the whole aligned runs of 1, 2, 4, .. height / 2 blocks: conv_id, run, digest."""
    whole = cut.filter(F.size("symbols") == BLOCK)
    joined = F.aggregate("symbols", F.lit(b""), lambda a, x: F.concat(a, x))
    runs, size = [whole.select("conv_id", F.col("block").alias("run"), _sha(joined).alias("digest"))], 2
    while size < height:
        odd = F.col("run") % 2 == 1
        left, right = F.max(F.when(~odd, F.col("digest"))), F.max(F.when(odd, F.col("digest")))
        pairs = runs[-1].groupBy("conv_id", F.floor(F.col("run") / 2).alias("run")).agg(left.alias("_l"), right.alias("_r"))
        pairs = pairs.filter(F.col("_l").isNotNull() & F.col("_r").isNotNull())
        runs.append(settle(pairs.select("conv_id", "run", _sha("_l", "_r").alias("digest")), "trie-runs"))
        size *= 2
    return runs


def _starts(cut: DataFrame, lengths: DataFrame, height: int) -> DataFrame:
    """conv_id, block, and the name of the prefix before each block; `height` is the recursion's in blocks."""
    # what is left to cut: (sequence, block at which a part begins, name of the prefix above it)
    parts = lengths.select("conv_id", "length", F.lit(0).cast("long").alias("block"), _root().alias("start"))
    if height == 1:
        return parts
    runs = _runs(cut, height)
    half, at = height // 2, len(runs) - 1
    while half:
        reach = parts.filter(F.col("length") >= (F.col("block") + half) * BLOCK).withColumn("run", F.floor(F.col("block") / half))
        below = reach.join(runs[at], ["conv_id", "run"]).select("conv_id", "length", (F.col("block") + half).alias("block"), _sha("start", "digest").alias("start"))
        parts = parts.unionByName(settle(below, "trie-cuts"))
        half, at = half // 2, at - 1
    return parts


def named_prefixes(turns: DataFrame, lengths: DataFrame) -> tuple[DataFrame, int]:
    """Blocks with the names of their prefixes: conv_id, length, block, words, and `names`, first that of the prefix before the block; and the height of the recursion in
    blocks. A sequence of no turns has none."""
    longest = lengths.agg(F.max("length")).first()[0] or 0
    height = 1 << int(longest // BLOCK).bit_length()  # no sequence reaches it
    cut = blocks(turns)
    starts = settle(_starts(cut, lengths, height), "trie-starts")
    behind = starts.select("conv_id", (F.col("block") - 1).alias("block"), F.col("start").alias("end"))
    begun = cut.join(starts, ["conv_id", "block"]).join(behind, ["conv_id", "block"], "left")
    names = F.aggregate("symbols", F.array("start"), lambda a, x: F.concat(a, F.array(_sha(F.element_at(a, -1), x))))
    # the last prefix of a whole block ends at a cut and has its name from there
    names = F.when(F.col("end").isNull(), names).otherwise(F.concat(F.slice(names, 1, BLOCK), F.array("end")))
    return settle(begun.select("conv_id", "length", "block", "words", names.alias("names")), "trie-names"), height


def members(named: DataFrame, lengths: DataFrame) -> DataFrame:
    """Every prefix of every sequence: conv_id, length, depth, name, the name of the prefix before it, and the words of its last turn."""
    each = F.transform("words", lambda w, i: F.struct((i + 1).cast("long").alias("i"), F.element_at("names", i + 2).alias("name"), F.element_at("names", i + 1).alias("parent"), w.alias("words")))
    rows = named.select("conv_id", "length", "block", F.explode(each).alias("_p"))
    rows = rows.select("conv_id", "length", (F.col("block") * BLOCK + F.col("_p.i")).alias("depth"), "_p.name", "_p.parent", "_p.words")
    return rows.unionByName(lengths.select("conv_id", "length", F.lit(0).cast("long").alias("depth"), _root().alias("name"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("words")))


def _spread(sums: DataFrame, named: DataFrame, depths: int) -> DataFrame:
    """Sums (conv_id, depth, leaves, saved) given to the last `depths` depths up to their own, on the way of their sequence."""
    last = F.floor((F.col("depth") - 1) / BLOCK)
    first = last - (depths // BLOCK - 1) if depths > BLOCK else last
    ways = sums.select("conv_id", "depth", "leaves", "saved", F.explode(F.sequence(first, last)).alias("block"))
    found = ways.join(named.select("conv_id", "block", "names"), ["conv_id", "block"])
    # names[0] belongs to the block before
    upto = F.least(F.size("names") - 1, F.col("depth") - F.col("block") * BLOCK).cast("int")
    each = F.transform(F.sequence(F.lit(1), upto), lambda i: F.struct((F.col("block") * BLOCK + i).alias("depth"), F.element_at("names", i + 1).alias("name"), F.element_at("names", i).alias("parent")))
    rows = found.select("conv_id", "leaves", "saved", F.explode(each).alias("_p")).select("conv_id", "leaves", "saved", "_p.*")
    added = rows.groupBy("name", "parent", "depth").agg(F.min("conv_id").alias("conv_id"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    return settle(added, "trie-grafts")


def grafted(nodes: DataFrame, named: DataFrame, height: int) -> DataFrame:
    """Per node name the sums of `leaves` and `saved` over its subtree.

    Inside a block every node gives its own to itself and its ancestors there. Then heights ascend. At each, the trees that begin right below a cut have their sums within that
    height; a cut node's sum of them is added to the node and to its ancestors above, up to where its part begins: at most half the height, however many sequences pass
    through. Any sequence through a tree passes through its cut node and the ancestors, so one of them shows the way.
    """
    deep = nodes.filter(F.col("depth") > 0)
    sums = _spread(deep, named, BLOCK)
    size = 2
    while size <= height:
        half = size // 2 * BLOCK
        below = sums.filter((F.col("depth") - 1) % (size * BLOCK) == half)
        cuts = below.groupBy("parent", "depth").agg(F.min("conv_id").alias("conv_id"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        sums = sums.unionByName(_spread(cuts.withColumn("depth", F.col("depth") - 1), named, half))
        size *= 2
    add = [F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")]
    tops = sums.filter(F.col("depth") == 1).select(F.col("parent").alias("name"), "leaves", "saved")
    root = nodes.filter(F.col("depth") == 0).select("name", "leaves", "saved").unionByName(tops)
    return sums.groupBy("name").agg(*add).unionByName(root.groupBy("name").agg(*add))


def _hashes(batches):
    """One digest per name of the chunks of its ids, which come in order; a list is never whole in memory."""
    name, sha = None, None
    for batch in batches:
        done = []
        for n, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if n == name:
                sha.update(b",")
            else:
                if name is not None:
                    done.append((name, sha.hexdigest()))
                name, sha = n, hashlib.sha256()
            sha.update(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["name", "ends_sha256"])
    if name is not None:
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([sha.hexdigest()], pa.string())], names=["name", "ends_sha256"])


def end_digests(held: DataFrame) -> DataFrame:
    """Per name of a whole sequence the digest of the comma-joined ids of its sequences, ascending. Ids are joined in chunks; lists of several chunks are hashed as a stream of them."""
    ends = held.filter(F.col("depth") == F.col("length")).select("name", "conv_id")
    placed = placed_rows(ends, ["name"], [F.col("conv_id")])
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunk = F.floor(F.col("position") / CHUNK).alias("chunk")
    chunks = settle(placed.groupBy("name", chunk, (F.col("group_rows") > CHUNK).alias("several")).agg(ids.alias("ids")), "trie-ends")
    long = chunks.filter("several").repartition("name").sortWithinPartitions("name", "chunk").select("name", "ids")
    return chunks.filter("not several").select("name", F.sha2("ids", 256).alias("ends_sha256")).unionByName(long.mapInArrow(_hashes, "name binary, ends_sha256 string"))


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """Nodes of the trie of sequences (conv_id, place, symbol, words) of given lengths: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    named, height = named_prefixes(turns, lengths)
    held = members(named, lengths)
    nodes = held.groupBy("name", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("parent").alias("parent"), F.coalesce(F.max("words"), F.lit(0)).alias("words")
    )
    nodes = settle(nodes, "trie-nodes")
    children = nodes.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = settle(nodes.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")}), "trie-counted")
    whole = nodes.join(grafted(nodes, named, height), "name").join(end_digests(held), "name", "left")
    whole = settle(whole.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))).drop("leaves", "saved", "words"), "trie-sums")
    up = whole.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    # a node may have very many children
    return salted_join(whole, up, ["parent"], "left").select(*columns)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all conversations, rebuilt with their families' beginnings."""
    return trie(*rebuilt(symbols(conversations)))
