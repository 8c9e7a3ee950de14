"""Spelling variants grouped by single edits.

Words are counted over all documents; two words are near if one inserted, deleted or replaced code point turns one into
the other. For two words of which the longer has L code points that holds exactly if their common prefix and common suffix
together reach L - 1. Then they also share the first half of the longer word, or its last half; these halves, with L, name
groups. Large groups are cut into blocks by a hash of the word, and each pair of blocks is one tile: the words of a tile have L or L - 1
code points, so they fill padded matrices, left- and right-aligned, and a tile compares all its rows at once. A pair
that shares both halves is taken from the group of the first half only, so every pair comes once.

A word's form is its most frequent near word, if that is ``ratio`` times as frequent; counts then grow along forms, so
following them ends, in a number of rounds that is the logarithm of the longest chain.

Defined results: a null text has no words; a null id counts as the empty text in the hash of a run; repeated rows count
each; a tie between near words of one count goes to the smallest in code-point order; no documents give no rows. Words
of any length are compared whole: a tile's rows are dealt with in slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.llm.common import small
from headway.session import settle

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of a block; a group of more words has several blocks.
BLOCK = 512
#: Cells compared at once in a tile.
CELLS = 4_000_000

NEAR = "word string, n long, near string, near_n long"


def spelled(doc_id: Column, run: Column, every: int) -> Column:
    """The run, without one code point where a hash of document and run is divisible by ``every``."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run)
    h = F.crc32(key.cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def words_of(docs: DataFrame, letters: int = 6, least: int = 5, every: int = 199) -> DataFrame:
    """(word, n): words of at least ``letters`` code points that occur ``least`` times or more in all documents."""
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, UPPER.lower())
    # a run that is too short stays so when it loses a code point
    runs = docs.select(F.col("doc_id"), F.explode(F.regexp_extract_all(text, F.lit(f"[a-zÀ-ÿ]{{{letters},}}"), F.lit(0))).alias("run"))
    return (runs.select(spelled(F.col("doc_id"), F.col("run"), every).alias("word")).filter(F.length("word") >= letters)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least))


def tiles(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(length, first, parts): pairs of blocks of one group; parts are one or two lists of (word, n)."""
    n = F.length("word")
    keys = []
    for longer in (n, n + 1):
        half = F.floor(longer / 2).cast("int")
        keys.append(F.struct(longer.alias("length"), F.lit(True).alias("first"), F.substring("word", F.lit(1), half).alias("part")))
        keys.append(F.struct(longer.alias("length"), F.lit(False).alias("first"), F.right("word", longer - half).alias("part")))
    members = words.select("word", "n", F.explode(F.array(*keys)).alias("key")).select("key.*", "word", "n")
    group = ["length", "first", "part"]
    large = members.groupBy(group).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > block)
    large = settle(large.select(*group, F.ceil(F.col("size") / block).cast("int").alias("blocks")))
    dealt = members.join(small(large), group, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    blocks = dealt.groupBy(*group, "blocks", "block").agg(F.collect_list(F.struct("word", "n")).alias("words"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    paired = blocks.select(*group, "block", "words", other)
    return (paired.groupBy(*group, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
            .agg(F.collect_list("words").alias("parts"))
            .filter((F.size("parts") > 1) | ((F.col("low") == F.col("high")) & (F.size(F.col("parts")[0]) > 1)))  # the other block may be empty
            .select("length", "first", "parts"))


def matrices(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, aligned left and right; padding is no code point of a word."""
    left = np.zeros((len(words), width), np.uint32)
    right = np.zeros((len(words), width), np.uint32)
    for i, w in enumerate(words):
        codes = np.frombuffer(w.encode("utf-32-le"), np.uint32)
        left[i, :len(codes)] = codes
        right[i, width - len(codes):] = codes
    return left, right


def single_edits(a: list[str], b: list[str], width: int, first: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``a`` and ``b`` one edit apart, the longer of ``width`` code points; of those that share the first half, only if ``first``."""
    (left, right), (left_b, right_b) = matrices(a, width), matrices(b, width)
    sizes, sizes_b = np.array([len(w) for w in a]), np.array([len(w) for w in b])
    half = width // 2
    across = max(1, CELLS // width)
    for j in range(0, len(b), across):
        down = max(1, across // min(across, len(b) - j))
        for i in range(0, len(a), down):
            rows, cols = slice(i, i + down), slice(j, j + across)
            same = left[rows, None, :] == left_b[None, cols, :]
            prefix = np.where(same.all(2), width, same.argmin(2))
            same = (right[rows, None, :] == right_b[None, cols, :])[:, :, ::-1]
            suffix = np.where(same.all(2), width, same.argmin(2))
            fits = (prefix + suffix >= width - 1) & (np.maximum(sizes[rows, None], sizes_b[None, cols]) == width)
            fits &= prefix < width  # not a word with itself
            if not first:
                fits &= prefix < half
            x, y = np.nonzero(fits)
            yield x + i, y + j


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of each tile, both ways round."""
    for batch in batches:
        for width, first, parts in zip(*(batch.column(k) for k in ("length", "first", "parts"))):
            lists = [(part.values.field("word").to_pylist(), part.values.field("n").to_numpy()) for part in parts]
            (a, n_a), (b, n_b) = lists[0], lists[-1]
            one = len(lists) == 1
            for x, y in single_edits(a, b, width.as_py(), first.as_py()):
                if one:
                    x, y = x[x < y], y[x < y]
                if len(x):
                    left, right = pa.array([a[i] for i in x], pa.string()), pa.array([b[i] for i in y], pa.string())
                    n_x, n_y = pa.array(n_a[x], pa.int64()), pa.array(n_b[y], pa.int64())
                    for columns in ([left, n_x, right, n_y], [right, n_y, left, n_x]):
                        yield pa.RecordBatch.from_arrays(columns, ["word", "n", "near", "near_n"])


def near(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n, near, near_n): every pair of near words, both ways round."""
    return tiles(words, block).mapInArrow(compare, NEAR)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last. Each round doubles the steps a row has taken."""
    reached = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        reached = settle(reached.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        if reached.filter("moved").isEmpty():
            return reached.select("word", "root")
        reached = reached.select("word", "root")


def group(words: DataFrame, ratio: int = 5, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of ``words`` (word, n)."""
    words = settle(words)
    best = near(words, block).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("fewer"), F.col("near").alias("form"))).alias("best"))
    found = best.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.fewer")).alias("form_n"))
    named = words.join(found, "word", "left")
    is_form = F.col("form_n") >= ratio * F.col("n")
    named = settle(named.select("word", F.when(is_form, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("form_n")).alias("form_n")))
    last = roots(named.filter(F.col("form").isNotNull()))
    return named.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame) -> DataFrame:
    """The groups of all documents' words."""
    return group(words_of(docs))
