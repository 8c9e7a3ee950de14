"""Removal of repeated runs of lines by winnowing.

Blank lines aside, every line has a hash. A block is the shortest run of lines from a given one that holds at least
``BLOCK`` words; its hash is the fingerprint candidate of that line. From every window of lines that holds at least
``GUARANTEE`` words the block with the least hash is selected, so two texts that share a run of that many words share
a selected block. Occurrences of a block are ordered by doc_id, then hash of the text, then line. Each is extended line
by line both ways, past its neighbouring selected blocks and by ``GUARANTEE`` words at least, as far as any earlier
occurrence shares its lines; what it has in common with any of them is deleted. So no line of a run of ``GUARANTEE``
words that stands in an earlier document is left.

Each block travels with one hash for every length of the context on either side, so extension needs no second look at
a text, and a document's lines are carried a few times, however often a block recurs.

Defined results: null and empty texts stay as they are; a text that loses every line becomes empty; blank lines around
deleted lines stay; null doc_ids come last; rows that agree in id and text are one document and fare alike (copies
under another id are later occurrences); an empty table gives no rows.
"""

from __future__ import annotations

import struct
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headway.llm.common import texts
from headway.session import settle

#: Words of a block, and of a shared run that is found for sure.
BLOCK = 25
GUARANTEE = 50

BLOCKS = ("hash long, line int, length int, before array<long>, after array<long>")


def line_words(text: str) -> list[tuple[int, str, int]]:
    """(line number, normalised line, words) of the lines that are not blank."""
    out = []
    for i, line in enumerate(text.split("\n")):
        words = line.split()
        if words:
            out.append((i, " ".join(words), len(words)))
    return out


def selected(hashes: list[int], counts: list[int], block: int, guarantee: int, mix) -> list[tuple[int, int, int]]:
    """(first line, lines, hash) of the selected blocks of a text, in order.

    ``mix`` hashes a tuple of line hashes. Among equal hashes of a window the last one is taken.
    """
    n = len(hashes)
    ends: list[int] = []  # exclusive end of the block that starts at i, or n + 1 if the text ends before it is full
    end = total = 0
    for i in range(n):
        while end < n and total < block:
            total += counts[end]
            end += 1
        ends.append(end if total >= block else n + 1)
        total -= counts[i]
    values = [mix(hashes[i:ends[i]]) if ends[i] <= n else None for i in range(n)]
    picked: set[int] = set()
    end = total = 0
    lines: list[int] = []  # candidates of the window, values ascending: a monotone queue
    last = 0
    for i in range(n):
        while end < n and total < guarantee:
            total += counts[end]
            end += 1
        if total < guarantee:
            break
        while last < n and ends[last] <= end:
            while lines and values[lines[-1]] >= values[last]:
                lines.pop()
            lines.append(last)
            last += 1
        while lines and lines[0] < i:
            lines.pop(0)
        if lines:
            picked.add(lines[0])
        total -= counts[i]
    return [(i, ends[i] - i, values[i]) for i in sorted(picked)]


def fingerprints(docs: DataFrame, block: int = BLOCK, guarantee: int = GUARANTEE) -> DataFrame:
    """One row per selected block: doc_id, text hash h, hash, line, length, before, after.

    ``line`` counts lines that are not blank. before and after hold, for k = 1, 2, ..., the hash of the block with k
    lines on that side, as far as the start of the previous and the end of the next selected block and by
    ``guarantee`` words at least: a run of that many words has a block that all its occurrences select within that
    distance of either end, though a neighbour may be selected in one of them only.
    """
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import xxhash

        def mix(run: list[int]) -> int:
            return xxhash.xxh3_64_intdigest(np.array(run, dtype=np.int64).tobytes()) - 2**63

        def chain(value: int, run: list[int]) -> list[int]:
            return list(accumulate(run, lambda x, y: xxhash.xxh3_64_intdigest(pair(x, y)) - 2**63, initial=value))[1:]

        pair = struct.Struct("<qq").pack
        for batch in batches:
            out: list[tuple] = []
            for doc, h, text in zip(batch["doc_id"], batch["h"], batch["text"]):
                lines = line_words(text)
                counts = [w for _, _, w in lines]
                if sum(counts) < guarantee:
                    continue
                hashes = [xxhash.xxh3_64_intdigest(s.encode()) - 2**63 for _, s, _ in lines]
                found = selected(hashes, counts, block, guarantee, mix)
                words = list(accumulate(counts, initial=0))  # before each line
                for k, (i, length, value) in enumerate(found):
                    low = found[k - 1][0] if k else 0
                    high = found[k + 1][0] + found[k + 1][1] if k + 1 < len(found) else len(lines)
                    end = i + length
                    low = min(low, bisect_right(words, words[i] - guarantee) - 1 if words[i] > guarantee else 0)
                    high = max(high, min(bisect_left(words, words[end] + guarantee), len(lines)))
                    out.append((doc, h, value, i, length, chain(value, hashes[low:i][::-1]), chain(value, hashes[end:high])))
            yield pd.DataFrame(out, columns=["doc_id", "h", "hash", "line", "length", "before", "after"])

    rows = texts(docs)
    kind = T.StructType([rows.schema["doc_id"], rows.schema["h"], *T.StructType.fromDDL(BLOCKS).fields])
    return rows.mapInPandas(find, kind)


def repeats(blocks: DataFrame) -> DataFrame:
    """(doc_id, h, first, last): runs of lines, not counting blank ones, that repeat an earlier occurrence.

    A block with k lines of its context is known by one hash, so the first occurrence of each such run tells whether any
    earlier text shares it: every occurrence reaches as far as the longest of them, and no pairs are formed.
    """
    # a hash that occurs once repeats nothing: counts come first, so that few blocks move with their context
    often = blocks.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("hash")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h", "line")
    again = settle(blocks.join(often, "hash").withColumn("own", order))

    def grown(side: int, chain: str):
        return F.transform(chain, lambda x, k: F.struct(F.lit(side).alias("side"), (k + 1).alias("k"), x.alias("key")))

    # side -1 is the context before the block, 1 the one after it, 0 the block alone
    alone = F.array(F.struct(F.lit(0).alias("side"), F.lit(0).alias("k"), F.col("hash").alias("key")))
    runs = again.select("own", "length", F.explode(F.concat(alone, grown(-1, "before"), grown(1, "after"))).alias("r")).select("own", "length", "r.side", "r.k", "r.key")
    original = (runs.groupBy("side", "key").agg(F.min("own").alias("at"), F.count(F.lit(1)).alias("n"))
                .filter(F.col("n") > 1).select("side", "key", "at"))
    later = runs.join(original, ["side", "key"]).filter(F.col("own") > F.col("at"))

    # an occurrence inside its original's own document stays clear of the original
    line, end = F.col("own.line"), F.col("own.line") + F.col("length")
    own = F.col("own.doc_id").eqNullSafe(F.col("at.doc_id")) & (F.col("own.h") == F.col("at.h"))
    low = F.when(own, F.col("at.line") + F.col("length")).otherwise(F.lit(0))
    first = F.when(F.col("side") == 1, end).otherwise(F.greatest(line - F.when(F.col("side") == -1, F.col("k")).otherwise(0), low))
    last = F.when(F.col("side") == -1, line - 1).otherwise(end - 1 + F.col("k"))
    found = later.select("own", first.alias("first"), last.alias("last")).filter(F.col("first") <= F.col("last"))
    return found.groupBy("own").agg(F.min("first").alias("first"), F.max("last").alias("last")).select("own.doc_id", "own.h", "first", "last")


def remove_repeats(docs: DataFrame, block: int = BLOCK, guarantee: int = GUARANTEE) -> DataFrame:
    """(row, removed): the documents, whatever their columns, with repeated runs taken out of ``text``, and the lines taken out."""
    blocks = settle(fingerprints(docs, block, guarantee))
    runs = repeats(blocks).distinct().groupBy("doc_id", "h").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    packed = docs.select(F.struct(*docs.columns).alias("row"))
    h = F.xxhash64(F.coalesce(F.col("row.text"), F.lit("")))
    joined = packed.join(runs, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (h == F.col("h")), "left")

    @F.pandas_udf("text string, removed long")
    def rebuild(texts: pd.Series, cuts: pd.Series) -> pd.DataFrame:
        done = []
        for t, runs in zip(texts, cuts):
            if t is None or runs is None:
                done.append((t, 0))
                continue
            gone: set[int] = set()
            for r in runs:
                gone.update(range(r["first"], r["last"] + 1))
            at, left, removed = -1, [], 0
            for line in t.split("\n"):
                filled = bool(line.split())
                at += filled
                if filled and at in gone:
                    removed += 1
                else:
                    left.append(line)
            done.append(("\n".join(left) if any(line.strip() for line in left) else "", removed))
        return pd.DataFrame(done, columns=["text", "removed"])

    out = joined.select("row", rebuild("row.text", "runs").alias("done"))
    return out.select(F.col("row").withField("text", F.col("done.text")).alias("row"), F.col("done.removed").alias("removed"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, lines removed, and the digest and length of what is left of each document."""
    done = remove_repeats(docs.select("doc_id", "text"))
    text = F.coalesce("row.text", F.lit(""))
    return done.select("row.doc_id", F.col("removed").alias("n_removed"), F.length(text).cast("long").alias("n_chars_left"), F.sha2(text, 256).alias("text_sha256"))


def keep_firsts(docs: DataFrame) -> DataFrame:
    """Documents without their repeated runs; those of which nothing is left, though they had a text, go."""
    done = remove_repeats(docs)
    return done.filter((F.col("removed") == 0) | (F.coalesce("row.text", F.lit("")) != "")).select("row.*")
