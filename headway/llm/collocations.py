"""Phrase collocations from FM-indexes.

Each task cuts its texts into shards of bounded size, one language each, and indexes the word ids of a shard: positions sorted
by the next ``depth`` words, the word before each (the Burrows-Wheeler transform) and ranks in it, for the text and for the
reversed text. A phrase is an interval of rows in either index. Extending all phrases of a length by a word to the right or
left, in turn, gives the phrases that are one word longer with their counts. Counts are summed over the shards.

A phrase can't be more frequent than its parts. So words and pairs are counted first, and a longer phrase is only formed
where both parts that are one word shorter may be frequent, which a Bloom filter of bounded size tells; it lets some others
through and loses none.

Defined results: a null text has no words; a null language is ``und``; repeated rows count each; phrases end at
punctuation, line ends and document ends; no documents give no rows. A shard is cut between pieces; a single piece larger
than a shard is a shard of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headway.session import settle

#: Bytes of text in a shard; rows in a batch of counts.
SHARD = 4_000_000
ROWS = 50_000
#: Bits of the filter for each phrase in it, and bits at most.
BITS_EACH = 16
MOST_BITS = 1 << 28
#: A word that stands in many phrases meets them under so many keys.
SALTS = 8

BREAKS = b".,;:!?\n\x0b\x0c\r"
COUNTS = "lang string, length int, phrase string, n long"


# ------------------------------------------------------------------ words of a shard
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD, SPACE, BREAK = 0, 1, 2
KIND = np.zeros(256, np.uint8)
KIND[list(b" \t")] = SPACE
KIND[list(BREAKS)] = BREAK


def shards(texts: pa.Array, size: int = SHARD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes of consecutive texts, and flags of the bytes that begin a text; cut between pieces."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    begins = offsets[:-1] - offsets[0]
    first = np.zeros(len(data) + 1, bool)
    first[begins] = True
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        if end < len(data):
            cuts = np.flatnonzero((KIND[data[at:end]] == BREAK) | first[at:end])
            cuts = cuts[cuts > 0]
            if len(cuts):
                end = at + int(cuts[-1])
            else:  # a piece longer than a shard
                step = np.flatnonzero((KIND[data[end:]] == BREAK) | first[end:-1])
                end = end + int(step[0]) if len(step) else len(data)
        yield data[at:end], first[at:end]
        at = end


def symbols(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Word ids from 1, with 0 before, between and after pieces; and the words by id - 1."""
    kind = KIND[data]
    word = kind == WORD
    start = word.copy()
    start[1:] &= ~word[:-1] | first[1:]
    end = word.copy()
    end[:-1] &= ~word[1:] | first[1:]
    starts = np.flatnonzero(start)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(np.flatnonzero(end) + 1 - starts, out=offsets[1:])
    letters = LOWER[data[word]]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    coded = words.dictionary_encode()
    piece = np.searchsorted(np.flatnonzero((kind == BREAK) | first), starts, "right")
    piece = np.cumsum(np.diff(piece, prepend=piece[:1]) > 0) if len(piece) else piece
    text = np.zeros(len(starts) + (int(piece[-1]) if len(piece) else 0) + 2, np.int64)
    text[np.arange(len(starts)) + piece + 1] = coded.indices.to_numpy() + 1
    return text, coded.dictionary


# ------------------------------------------------------------------ index
class Index:
    """Burrows-Wheeler transform of a text of symbols, sorted by the first ``depth`` symbols."""

    def __init__(self, text: np.ndarray, depth: int):
        bits = max(1, int(text.max(initial=0)).bit_length())
        each = 62 // bits  # symbols to a sort key
        keys = []
        for at in range(0, depth, each):
            key = np.zeros(len(text), np.int64)
            for k in range(at, min(at + each, depth)):
                key = key << bits | np.roll(text, -k)
            keys.append(key)
        rows = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
        self.before = text[rows - 1]
        self.sizes = np.bincount(text)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self._ranks: np.ndarray | None = None

    def step(self, symbol: np.ndarray, low: np.ndarray) -> np.ndarray:
        """First row of each phrase that has ``symbol`` before the phrase whose rows begin at ``low``."""
        n = len(self.before)
        if self._ranks is None:
            self._ranks = np.sort(self.before * n + np.arange(n))
        return np.searchsorted(self._ranks, symbol * n + low)

    def extensions(self, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """(phrase, symbol, rows before, size): symbols before each phrase, and how many of its rows have smaller ones."""
        owner = np.repeat(np.arange(len(low)), size)
        rows = np.arange(len(owner)) + np.repeat(low - (np.cumsum(size) - size), size)
        width = len(self.sizes)
        pairs, n = np.unique(owner * width + self.before[rows], return_counts=True)
        owner, symbol = pairs // width, pairs % width
        below = np.cumsum(n) - n
        head = np.flatnonzero(np.diff(owner, prepend=-1))
        below -= np.repeat(below[head], np.diff(np.append(head, len(owner))))
        real = symbol > 0
        return owner[real], symbol[real], below[real], n[real]


class Both:
    """Index of a text and of its reverse; phrases keep an interval of either and grow at both ends."""

    def __init__(self, text: np.ndarray, depth: int):
        self.text, self.depth = text, depth
        self._made: dict[bool, Index] = {}

    def side(self, right: bool) -> Index:
        """Extends to the right or left."""
        if right not in self._made:
            self._made[right] = Index(self.text[::-1] if right else self.text, self.depth)
        return self._made[right]

    def levels(self, allowed) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(phrases as rows of word ids, counts) of 1, 2 .. ``depth`` words; ``allowed`` says which may be a longer one's part."""
        sizes = np.bincount(self.text)
        words = np.flatnonzero(sizes[1:]) + 1
        phrases, size = words[:, None], sizes[words]
        low = {side: (np.cumsum(sizes) - sizes)[words] for side in (True, False)}
        yield phrases, size
        for length in range(2, self.depth + 1):
            right = length % 2 == 0
            keep = allowed(phrases)
            phrases, size, low = phrases[keep], size[keep], {side: x[keep] for side, x in low.items()}
            owner, symbol, below, size = self.side(right).extensions(low[right], size)
            grown = [phrases[owner], symbol[:, None]] if right else [symbol[:, None], phrases[owner]]
            other = low[not right][owner] + below
            if length < self.depth:
                low = {not right: other, right: self.side(right).step(symbol, low[right][owner]) if length + 1 < self.depth else other}
            phrases = np.hstack(grown)
            yield phrases, size


# ------------------------------------------------------------------ filter of frequent phrases
def mixed(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    h = (h ^ more) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(29)


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def positions(lang: str, columns: list[np.ndarray], size: int) -> list[np.ndarray]:
    """The two bits of phrases, given the hashes of their first, second .. words, in a filter of ``size`` bits."""
    h = np.full(len(columns[0]), word_hashes([lang.encode()])[0])
    for c in columns:
        h = mixed(h, c)
    return [(x & np.uint64(size - 1)).astype(np.int64) for x in (h, h >> np.uint64(32))]


def passes(bits: np.ndarray, lang: str, columns: list[np.ndarray]) -> np.ndarray:
    """Whether the filter knows each phrase."""
    found = np.ones(len(columns[0]), bool)
    for at in positions(lang, columns, len(bits) * 8):
        found &= bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
    return found


def filter_bits(frequent: DataFrame) -> np.ndarray:
    """Bloom filter of (lang, phrase) rows: two bits each, in as many bits as suit them, MOST_BITS at most."""
    size = 1 << 18
    rows = frequent.count()
    while size < min(MOST_BITS, rows * BITS_EACH):
        size *= 2

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sorts: dict[tuple[str, int], list[list[bytes]]] = {}
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()):
                words = phrase.encode().split(b" ")
                sorts.setdefault((lang, len(words)), []).append(words)
            for (lang, _), phrases in sorts.items():
                for at in positions(lang, [word_hashes(list(c)) for c in zip(*phrases)], size):
                    yield pa.RecordBatch.from_arrays([pa.array(at >> 15), pa.array(at & 32767)], ["piece", "at"])

    pieces = (frequent.select("lang", "phrase").mapInArrow(place, "piece long, at long")
              .groupBy("piece").agg(F.bitmap_construct_agg("at").alias("bits")).collect())
    bits = np.zeros(size // 8, np.uint8)
    for r in pieces:
        bits[r["piece"] * 4096:(r["piece"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return bits


# ------------------------------------------------------------------ counts
def joined(words: pa.Array, phrases: np.ndarray) -> pa.Array:
    columns = [words.take(pa.array(phrases[:, k] - 1)) for k in range(phrases.shape[1])]
    return columns[0] if len(columns) == 1 else pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.large_binary()))


def shard_counts(lang: str, texts: pa.Array, lengths: range, bits: np.ndarray | None, size: int) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases of the given lengths, and of all words under length 0."""
    def batch(length: int, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        m = len(n)
        return pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(m, np.int32))), pa.array(np.full(m, length, np.int32)), phrases.cast(pa.string()), pa.array(n.astype(np.int64))],
                                          ["lang", "length", "phrase", "n"])

    for data, first in shards(texts, size):
        text, words = symbols(data, first)
        if not len(words):
            continue

        hashes = word_hashes(words.to_pylist()) if bits is not None else None

        def may(phrases: np.ndarray) -> np.ndarray:
            if hashes is None or phrases.shape[1] < 2:
                return np.ones(len(phrases), bool)
            return passes(bits, lang, [hashes[c - 1] for c in phrases.T])

        if 1 in lengths:
            yield batch(0, pa.array([b""], pa.large_binary()), np.array([np.count_nonzero(text)]))
        for phrases, n in Both(text, max(lengths)).levels(may):
            length = phrases.shape[1]
            if length not in lengths:
                continue
            for at in range(0, len(n), ROWS):
                some, m = phrases[at:at + ROWS], n[at:at + ROWS]
                if length > 2:  # the other part of one word less
                    known = may(some[:, 1:] if length % 2 == 0 else some[:, :-1])
                    some, m = some[known], m[known]
                if len(m):
                    yield batch(length, joined(words, some), m)


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Batches put together until they have ``size`` bytes."""
    pending: list[pa.RecordBatch] = []
    for batch in batches:
        pending.append(batch)
        if sum(b.nbytes for b in pending) >= size:
            yield pa.Table.from_batches(pending)
            pending = []
    if pending:
        yield pa.Table.from_batches(pending)


def counted(docs: DataFrame, lengths: range, bits: np.ndarray | None = None, size: int = SHARD) -> DataFrame:
    """(lang, length, phrase, n) over all documents."""
    held = docs.sparkSession.sparkContext.broadcast(bits) if bits is not None else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # gives memory back between shards
        for rows in gathered(batches, size):
            langs = np.array(rows["lang"].to_pylist(), object)
            sizes = pc.binary_length(rows["text"]).to_numpy()
            for lang in sorted(set(langs)):
                own = np.flatnonzero(langs == lang)
                part = np.cumsum(sizes[own]) // size
                for k in np.unique(part):
                    texts = rows["text"].take(pa.array(own[part == k])).combine_chunks().cast(pa.large_binary())
                    yield from shard_counts(lang, texts, lengths, held.value if held is not None else None, size)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(count, COUNTS).groupBy("lang", "length", "phrase").agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, depth: int = 3, least: int = 10, size: int = SHARD) -> DataFrame:
    """(lang, length, phrase, n): phrases of 1 to ``depth`` words that occur ``least`` times; length 0 has a language's words."""
    found = settle(counted(docs, range(1, min(depth, 2) + 1), None, size).filter((F.col("length") == 0) | (F.col("n") >= least)))
    for length in range(3, depth + 1):
        bits = filter_bits(found.filter(F.col("length").between(2, length - 1)))
        longer = counted(docs, range(length, length + 1), bits, size).filter(F.col("n") >= least)
        found = found.unionByName(settle(longer))
    return found


# ------------------------------------------------------------------ scores
def scored(counts: DataFrame, depth: int = 3, inside: int = 50) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of two words and more that no longer one mostly stands for.

    The lowest-scoring cut of a phrase counts. Products are decimals of 38 digits: exact for counts below 10 to the 16th.
    """
    words = F.split("phrase", " ")
    phrases = counts.filter(F.col("length") > 1).select("lang", "length", "phrase", F.col("n").alias("a"))
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    part = lambda begin, n: F.array_join(F.slice(words, begin, n), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("length") - F.col("k")).alias("right"),
                       F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int").alias("salt"))
    known = counts.filter(F.col("length").between(1, depth - 1))
    # single words stand in many phrases
    known = known.select("lang", "phrase", "n", F.explode(F.when(F.col("length") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    for side, count in (("left", "l"), ("right", "r")):
        salt = F.when(F.instr(side, " ") == 0, F.col("salt")).otherwise(0)
        cuts = cuts.withColumn("_salt", salt).join(known.select("lang", F.col("phrase").alias(side), F.col("n").alias(count), F.col("salt").alias("_salt")), ["lang", side, "_salt"]).drop("_salt")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("over", (whole("a") * whole("a") * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)")).withColumn("under", (whole("l") * whole("r")).cast("decimal(38,0)"))
    cuts = cuts.withColumn("score", F.expr("over div under"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut")).select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.score")
    span = F.explode(F.sequence(F.lit(2), F.col("length") - 1)).alias("m")
    inner = phrases.filter(F.col("length") > 2).select("lang", "phrase", "length", "a", span)
    inner = inner.select("lang", "phrase", "a", "m", F.explode(F.sequence(F.lit(1), F.col("length") - F.col("m") + 1)).alias("at"))
    inner = inner.select("lang", part(F.col("at"), F.col("m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(inner, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    totals = counts.filter(F.col("length") == 0).select("lang", F.col("n").alias("n"))
    return kept.join(totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, depth: int = 3, least: int = 10, top: int = 2000, inside: int = 50, size: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best ``top`` phrases of each language."""
    rows = scored(phrase_counts(docs, depth, least, size), depth, inside)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
