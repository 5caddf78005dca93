"""Token ids in a binary file format: patched frame-of-reference blocks.

Ids of documents in ascending order are cut into blocks of 1,024. A block subtracts its minimum and packs the differences at the bit width
that `PERCENTILE` percent of them fit; the high bits of the others stand in an exception list. A row of the written table is a segment of
whole documents: its blocks, the byte at which each block starts, and the ids and ends of its documents. Spark's own writer stores the
segments, so that a task that is repeated leaves no second copy.

Block layout, little-endian: uint32 count of values, uint32 minimum, uint16 exceptions, uint8 width, uint8 zero; then 32 x width uint32 words
(32 lanes of 32 values each); then uint16 exception places; then uint32 high parts.

Ids of pieces of words are kept under two 64-bit hashes of a piece's bytes. The first finds an entry, the second confirms it: with 2^20 pieces remembered, a
piece is taken for another with a chance of 2^-108.

Defined results: a text that is null or empty has only the end id. Documents with equal ids stand in the order of their texts; null ids come first.
Rows that repeat are written as often as they come. Where the
content of an added token of the vocabulary stands in a text, its id is given, as the plain library call does. An empty table gives an empty file. A long text is one segment of its own.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattloom.llm.common import settle, small_join

BLOCK, LANES = 1024, 32
PERCENTILE = 90
SEGMENT = 1 << 16  # ids after which a segment ends with its document
CACHE = 1 << 20  # pieces of which a Python worker remembers the ids: about 40 bytes each
LONG = 256  # bytes of a piece beyond which it is not remembered
END_ID = 2
SEGMENTS = "shard int, position long, n long, block_starts array<int>, blocks binary, doc_ids array<long>, doc_ends array<long>"
HEAD = struct.Struct("<IIHBB")


def pack(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[bytes, list[int]]:
    """Blocks of uint32 ids, and the byte at which each starts."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return b"", []
    count = np.full(n, BLOCK)
    count[-1] = len(ids) - (n - 1) * BLOCK
    full = np.append(ids, np.full(n * BLOCK - len(ids), ids[-1], np.uint32)).reshape(n, BLOCK)
    low = full.min(axis=1)
    diff = full - low[:, None]
    at = min(BLOCK - 1, int(BLOCK * percentile / 100))
    mark = np.partition(diff, at, axis=1)[:, at]
    width = np.maximum(1, np.ceil(np.log2(mark.astype(np.float64) + 1)).astype(int))
    packed: list[bytes] = [b""] * n
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        values = (diff[rows] & np.uint32((1 << int(w)) - 1)).reshape(len(rows), 32, LANES)
        words = np.zeros((len(rows), w, LANES), np.uint32)
        for i in range(32):
            k, shift = divmod(i * int(w), 32)
            words[:, k] |= values[:, i] << np.uint32(shift)
            if shift + w > 32:
                words[:, k + 1] |= values[:, i] >> np.uint32(32 - shift)
        for r, x in zip(rows, words):
            packed[r] = x.tobytes()
    out, starts, size = [], [], 0
    for b in range(n):
        w = int(width[b])
        high = diff[b] >> np.uint32(w) if w < 32 else np.zeros(BLOCK, np.uint32)
        places = np.flatnonzero(high)
        body = HEAD.pack(int(count[b]), int(low[b]), len(places), w, 0) + packed[b] + places.astype("<u2").tobytes() + high[places].astype("<u4").tobytes()
        starts.append(size)
        out.append(body)
        size += len(body)
    return b"".join(out), starts


def unpack(blocks: bytes, starts) -> np.ndarray:
    """The ids of blocks; blocks of one width are unpacked together."""
    heads = [HEAD.unpack_from(blocks, s) for s in starts]
    full = np.zeros((len(heads), BLOCK), np.uint32)
    widths = np.array([h[3] for h in heads], int)
    for w in np.unique(widths):
        rows, size = np.flatnonzero(widths == w), int(w) * LANES
        words = np.stack([np.frombuffer(blocks, "<u4", size, starts[r] + HEAD.size) for r in rows]).reshape(len(rows), w, LANES)
        values = np.empty((len(rows), 32, LANES), np.uint32)
        mask = np.uint32((1 << int(w)) - 1)
        for i in range(32):
            k, shift = divmod(i * int(w), 32)
            v = words[:, k] >> np.uint32(shift)
            if shift + w > 32:
                v = v | words[:, k + 1] << np.uint32(32 - shift)
            values[:, i] = v & mask
        full[rows] = values.reshape(len(rows), BLOCK)
    for b, (_, low, exceptions, w, _) in enumerate(heads):
        at = starts[b] + HEAD.size + 4 * w * LANES
        places = np.frombuffer(blocks, "<u2", exceptions, at)
        full[b, places] |= np.frombuffer(blocks, "<u4", exceptions, at + 2 * exceptions) << np.uint32(w)
        full[b] += np.uint32(low)
    return full.ravel()[: sum(h[0] for h in heads)]


class Pieces:
    """Token ids of pieces, by hash, in flat arrays."""

    def __init__(self):
        self.key, self.check = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.at, self.n, self.again = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, bool)
        self.ids = np.empty(0, np.uint32)

    def find(self, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry of each hash, and whether there is one."""
        if not len(self.key):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return i, (self.key[i] == key) & (self.check[i] == check)

    def add(self, key: np.ndarray, check: np.ndarray, n: np.ndarray, ids: np.ndarray) -> None:
        """New entries with the numbers of their ids, which follow each other in `ids`."""
        at = np.cumsum(n) - n + len(self.ids)
        order = np.argsort(np.concatenate([self.key, key]), kind="stable")
        join = lambda a, b: np.concatenate([a, b])[order]
        self.key, self.check, self.at, self.n = join(self.key, key), join(self.check, check), join(self.at, at), join(self.n, n.astype(np.int32))
        self.again = join(self.again, np.zeros(len(key), bool))
        self.ids = np.concatenate([self.ids, ids])

    def forget(self, most: int) -> None:
        """Keeps the pieces that more than one batch had, if there are more than `most`; none if these are too many, too."""
        if len(self.key) <= most:
            return
        keep = np.flatnonzero(self.again) if self.again.sum() <= most else np.empty(0, np.int64)
        n = self.n[keep]
        self.ids = self.ids[spread(self.at[keep], n)]
        self.key, self.check, self.n, self.at = self.key[keep], self.check[keep], n, np.cumsum(n, dtype=np.int64) - n
        self.again = np.zeros(len(keep), bool)


def spread(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places at, at + 1, .. at + n - 1 of every run, one run after the other."""
    n = n.astype(np.int64)
    stop = np.cumsum(n)
    return np.repeat(at - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)


def _bytes(*ranges) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


# bytes that are white space or may begin a character that is
MAYBE_WHITE = _bytes((0x09, 0x0D), (0x1C, 0x20), (0xC2, 0xC2), (0xE1, 0xE3))
ALNUM = _bytes((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))
VISIBLE = _bytes((0x21, 0x7E))
PUNCTUATION = VISIBLE & ~ALNUM
ACCENTED = _bytes((0x80, 0x96), (0x98, 0xB6), (0xB8, 0xBF))  # second bytes of the letters behind 0xC3
PAIR = _bytes((0xC3, 0xDF))  # first bytes of two-byte characters that are not white space


def cuts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where texts, which begin at the given bytes, can be cut without changing their tokens.

    Byte-level vocabularies split a text into runs of letters, of digits and of other signs, each with one space before it, and runs of white space. So a split
    is certain before a space that a visible character follows, around a lone line end between visible characters, and before a sign behind a letter or digit.
    Bytes that leave it open are not cut at.
    """
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[begins] = True
    first[n] = True
    before = np.concatenate([np.zeros(1, np.uint8), data[:-1]])
    letter_end = ALNUM[data] | (before == 0xC3) & ACCENTED[data]
    solid_end = VISIBLE[data] | PAIR[before] & (data >= 0x80)
    # the next byte belongs to the same text and begins a character that is not white space
    solid_next = np.append(~MAYBE_WHITE[data[1:]], False) & ~first[1:]
    inner = ~first[:n]
    behind = lambda x: np.concatenate([np.zeros(1, bool), x[:-1]])
    line_end = (data == 0x0A) & behind(solid_end) & solid_next & inner
    cut = (data == 0x20) & solid_next
    cut |= line_end | behind(line_end)
    cut |= PUNCTUATION[data] & behind(letter_end) & inner
    cut |= first[:n]
    return np.flatnonzero(cut)


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def hashes(data: bytes, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each piece; `data` has eight bytes more than the pieces."""
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    out = [size.astype(np.uint64) * _ODD[0], size.astype(np.uint64) * _ODD[1]]
    rest, k = np.arange(len(start)), 0
    while len(rest):
        w = words[start[rest] + 8 * k] & _MASKS[np.minimum(size[rest] - 8 * k, 8)]
        for i, h in enumerate(out):
            x = ((h[rest] ^ w) + _ODD[1 - i]) * _ODD[i]
            x ^= x >> np.uint64(32 - 3 * i)
            x *= _ODD[1 - i]
            h[rest] = x ^ x >> np.uint64(29 + 3 * i)
        k += 1
        rest = rest[size[rest] > 8 * k]
    return out[0], out[1]


class Encoder:
    """Ids of whole texts, put together from the ids of their pieces (see `cuts`); pieces that are not remembered go to the library, many in one call.
    Texts in which an added token (such as <|endoftext|>) stands are encoded whole, as are all texts of vocabularies of another kind."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        d = json.loads(definition)
        pre = d.get("pre_tokenizer") or {}
        self.by_word = not d.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.added = [t["content"] for t in d.get("added_tokens") or [] if t["content"]]
        self.by_word = self.by_word and not any(c.isspace() for t in self.added for c in t)  # pieces that are joined never make an added token
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t[:1] == "\u0120"]] = True  # how byte-level vocabularies write a space
        line = self.tokenizer.encode("a\na", add_special_tokens=False).ids
        self.line_end = line[1] if len(line) == 3 else None
        self.known = Pieces()

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _one(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of each piece, and the ids, in one call for all; the library says to which piece an id belongs."""
        e = self.tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        return np.bincount(np.array(e.word_ids, np.int64), minlength=len(pieces)), np.array(e.ids, np.uint32)

    def _learned(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids and ids of pieces that are not known.

        Pieces of a space and visible characters are encoded as one text, in which only a piece's first token begins with a space; pieces of visible
        characters alone as lines of one text, between which the token of a line end stands; others piece by piece.
        """
        own = data[spread(start, size)]
        owner = np.repeat(np.arange(len(start)), size)
        odd = MAYBE_WHITE[own]
        head = np.cumsum(size) - size
        led = own[head] == 0x20
        odd[head[led]] = False
        plain = np.ones(len(start), bool)
        plain[owner[odd]] = False
        plain[led & (size == 1)] = False
        counts, places, found, total = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), [], 0
        for kind, chosen in (("led", np.flatnonzero(plain & led)), ("line", np.flatnonzero(plain & ~led)), ("rest", np.flatnonzero(~plain))):
            if not len(chosen):
                continue
            n = ids = None
            if kind == "led":
                ids = self._one(data[spread(start[chosen], size[chosen])].tobytes().decode())
                begin = np.flatnonzero(self.spaced[ids])
                if len(begin) == len(chosen):
                    n = np.diff(np.append(begin, len(ids)))
            elif kind == "line" and self.line_end is not None:
                text = np.insert(data[spread(start[chosen], size[chosen])], np.cumsum(size[chosen])[:-1], 0x0A)
                ids = self._one(text.tobytes().decode())
                ends = np.append(np.flatnonzero(ids == self.line_end), len(ids))
                if len(ends) == len(chosen):
                    n = np.diff(np.append(-1, ends)) - 1
                    ids = ids[ids != self.line_end]
            if n is None:
                buffer = data.tobytes()
                n, ids = self._each([buffer[a : a + b].decode() for a, b in zip(start[chosen].tolist(), size[chosen].tolist())])
            counts[chosen], places[chosen] = n, total + np.cumsum(n) - n
            found.append(ids)
            total += len(ids)
        return counts, np.concatenate(found)[spread(places, counts)]

    def _pieces(self, buffer: bytes, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts that begin at the given bytes of `buffer`, one after the other, and where each text's end; eight more bytes follow the last text."""
        data = np.frombuffer(buffer, np.uint8)[: len(buffer) - 8]
        texts = begins[begins < len(data)]
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(begins), np.int64)
        start = cuts(data, texts)
        size = np.diff(np.append(start, len(data)))
        short = np.flatnonzero(size <= LONG)
        key, check = hashes(buffer, start[short], size[short])
        unique, first, each = np.unique(key, return_index=True, return_inverse=True)
        clash = np.flatnonzero(check != check[first][each])  # pieces whose first hash is another piece's
        entry, known = self.known.find(unique, check[first])
        self.known.again[entry[known]] = True
        new = np.flatnonzero(~known)
        if len(new):
            at = short[first[new]]
            n, ids = self._learned(data, start[at], size[at])
            # an entry with the same first hash and another second one stays as it is
            taken = self.known.key[entry[new]] == unique[new] if len(self.known.key) else np.zeros(len(new), bool)
            if taken.any():
                other = np.zeros(len(unique), bool)
                other[new[taken]] = True
                clash = np.union1d(clash, np.flatnonzero(other[each]))
                keep = ~taken
                ids = ids[np.repeat(keep, n)]
                new, n, at = new[keep], n[keep], at[keep]
            self.known.add(unique[new], check[first[new]], n, ids)
            entry, _ = self.known.find(unique, check[first])
        place, count = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        place[short], count[short] = self.known.at[entry[each]], self.known.n[entry[each]]
        source = self.known.ids
        alone = np.sort(np.concatenate([np.flatnonzero(size > LONG), short[clash]]))
        if len(alone):
            # not remembered: their ids stand behind the known ones for this batch only
            found = [self._one(buffer[start[i] : start[i] + size[i]].decode()) for i in alone.tolist()]
            count[alone] = [len(f) for f in found]
            place[alone] = len(source) + np.cumsum(count[alone]) - count[alone]
            source = np.concatenate([source, *found])
        ids = source[spread(place, count)]
        ends = np.append(np.cumsum(count), 0)
        # a text's ids end where its last piece's do; empty texts end where they begin
        last = np.searchsorted(start, np.append(begins[1:], len(data)), side="left") - 1
        return ids, ends[last]

    def encode_flat(self, buffer: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie in `buffer` between the offsets, one after the other, and where each text's end."""
        if self.by_word and not any(t.encode() in buffer for t in self.added):
            self.known.forget(CACHE)
            return self._pieces(buffer + bytes(8), offsets[:-1])
        texts = [buffer[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        out: list = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if self.by_word and not any(x in t for x in self.added)]
        if plain:
            parts = [texts[i].encode() for i in plain]
            ids, ends = self._pieces(b"".join(parts) + bytes(8), np.cumsum([0, *map(len, parts)])[:-1])
            for i, x in zip(plain, np.split(ids, ends[:-1])):
                out[i] = x
        whole = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(whole, self._ids([texts[i] for i in whole])):
            out[i] = np.frombuffer(x, "<u4")
        return np.concatenate(out).astype(np.uint32), np.cumsum([len(x) for x in out])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        parts = [t.encode() for t in texts]
        ids, ends = self.encode_flat(b"".join(parts), np.cumsum([0, *map(len, parts)]))
        return np.split(ids, ends[:-1])


@functools.lru_cache(maxsize=1)
def encoder(definition: str) -> Encoder:
    return Encoder(definition)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _few(batches, most: int = 1 << 20):
    """Runs of rows with about `most` bytes of text: their ids, the bytes, and where each text begins and the last one ends."""
    names, parts, sizes, total = [], [], [np.zeros(1, np.int64)], 0
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        begin = 0
        while begin < len(texts):
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most - total, side="right")) - 1)
            end = min(end, len(texts))
            names.append(batch.column(0).slice(begin, end - begin))
            low, high = int(offsets[begin]), int(offsets[end])
            # a null text may have bytes behind it in the buffer; the offsets leave them out
            parts.append(texts.buffers()[2].slice(low, high - low).to_pybytes() if high > low else b"")
            sizes.append(np.diff(offsets[begin : end + 1]))
            total += high - low
            begin = end
            if total >= most:
                yield pa.concat_arrays(names), b"".join(parts), np.cumsum(np.concatenate(sizes))
                names, parts, sizes, total = [], [], [np.zeros(1, np.int64)], 0
    if names:
        yield pa.concat_arrays(names), b"".join(parts), np.cumsum(np.concatenate(sizes))


def write_tokens(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Writes the ids of (doc_id, text) as segments in the shared folder, shards in ascending order of doc_id; returns the table that was written."""
    spark = docs.sparkSession
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())  # a fixed file of some MB
    shards = shards or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def segments(batches):
        shard, own = TaskContext.get().partitionId(), encoder(vocabulary.value)
        position, size, ids, names, ends = 0, 0, [], [], []

        def segment():
            blocks, starts = pack(np.concatenate(ids))
            row = [[shard], [position], [size], [starts], [blocks], [pa.concat_arrays(names)], [np.concatenate(ends)]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, SCHEMA.types)], schema=SCHEMA)

        for docs, buffer, offsets in _few(batches):
            found, stops = own.encode_flat(buffer, offsets)
            found = np.insert(found, stops, end_id)
            stops = stops + np.arange(1, len(stops) + 1)
            first, at = 0, 0  # document and id at which the rest of the run begins
            while first < len(stops):
                last = int(np.searchsorted(stops, at + SEGMENT - size))
                full = last < len(stops)
                last = min(last, len(stops) - 1)
                ids.append(found[at : stops[last]])
                names.append(docs.slice(first, last + 1 - first))
                ends.append(stops[first : last + 1] - at + size)
                size += int(stops[last]) - at
                first, at = last + 1, int(stops[last])
                if full:
                    yield segment()
                    position, size, ids, names, ends = position + size, 0, [], [], []
        if names:
            yield segment()
        own.known.forget(CACHE // 2)

    # equal ids are dealt and ordered by their texts
    dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = dealt.repartitionByRange(shards, "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    return settle(dealt.mapInArrow(segments, SEGMENTS), "tokens")


SCHEMA = pa.schema(
    [("shard", pa.int32()), ("position", pa.int64()), ("n", pa.int64()), ("block_starts", pa.list_(pa.int32())), ("blocks", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_ends", pa.list_(pa.int64()))]
)


def read_segments(batches):
    """(doc_id, ids) of every document in batches of segments."""
    for batch in batches:
        for row in batch.to_pylist():
            ids, begin = unpack(row["blocks"], row["block_starts"]), 0
            for i, end in zip(row["doc_ids"], row["doc_ends"]):
                yield row["shard"], row["position"] + begin, i, ids[begin:end]
                begin = end


def read_digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""

    def digests(batches):
        for batch in batches:
            out = [(s, p, i, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for s, p, i, ids in read_segments([batch])]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), *[pa.int64()] * 4))], names=["shard", "_at", "doc_id", "n_tokens", "ids_crc32"])

    # one row per shard
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    total = files.groupBy("shard").agg(F.sum("n").alias("_n"))
    before = total.select("shard", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    read = files.mapInArrow(digests, "shard int, _at long, doc_id long, n_tokens long, ids_crc32 long")
    return small_join(read, before, ["shard"]).select("doc_id", (F.col("_before") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(files: DataFrame) -> DataFrame:
    """doc_id and ids of every document, from the files."""

    def whole(batches):
        for batch in batches:
            out = [(i, ids.astype(np.int64)) for _, _, i, ids in read_segments([batch])]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return files.mapInArrow(whole, "doc_id long, ids array<long>")
