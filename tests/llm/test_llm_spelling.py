"""Spelling variants against brute force."""

import collections
import random
import re
import zlib

import numpy as np

from headway.llm import spelling


def counted(rows):
    counts = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x7f" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def cuts(w):
    return {w[:i] + w[i + 1:] for i in range(len(w))}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and a in cuts(b)


def grouped(words):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {w: (form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words}


def asked(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def some_rows():
    rng = random.Random(3)
    bases = ["aaaaaa", "ababab", "èèçabab", "aabbaab", "bananas", "abcdefg", "x" * 300]
    rows = []
    for doc in range(400):
        words = []
        for _ in range(rng.randrange(12)):
            w = rng.choice(bases)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1:], w[:i] + "a" + w[i:], w[:i] + "b" + w[i + 1:]])
            words.append(w if rng.random() < 0.8 else w.upper())
        rows.append((doc, rng.choice([" ", ", ", "-", "1"]).join(words)))
    return rows + [(None, "ababab ababab"), (None, None), (1, None), (2, ""), (3, "bananas " * 400), (3, "bananas " * 400), (4, "×÷" * 4), (5, "ÀÉÈÇÑÖ")]


def test_groups_equal_brute_force(spark):
    rows = some_rows()
    words = counted(rows)
    docs = spark.createDataFrame([(d, t, "x", 1, 2, "k") for d, t in rows], "doc_id long, text string, word string, n long, blocks int, key string")
    assert {r.word: r.n for r in spelling.words_of(docs).collect()} == words
    want = grouped(words)
    assert asked(spelling.variants(docs)) == want
    assert sum(v[0] is not None for v in want.values()) > 5


def test_blocks_and_repeats_change_nothing(spark):
    words = counted(some_rows())
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert asked(spelling.group(table, block=3)) == grouped(words)
    pairs = spelling.near(table, block=3).toPandas()
    assert not pairs.duplicated(["word", "near"]).any()


def test_ties_go_to_the_smallest_code_point(spark):
    rows = [("baaaaa", 50), ("caaaaa", 50), ("aaaaaa", 5), ("éaaaaa", 50), ("zzzzzz", 7)]
    got = asked(spelling.group(spark.createDataFrame(rows, "word string, n long")))
    assert got["aaaaaa"] == ("baaaaa", "baaaaa", 5, 3, 50) and got["zzzzzz"] == (None, "zzzzzz", 7, 0, None) and got["éaaaaa"][0] is None


def test_long_chain_reaches_its_end(spark):
    chain = [("a" * (6 + i), 5 * 5 ** i) for i in range(9)]
    got = asked(spelling.group(spark.createDataFrame(chain, "word string, n long")))
    assert {v[1] for v in got.values()} == {"a" * 14} and got["aaaaaa"][0] == "aaaaaaa"


def test_no_rows(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_tile_compares_every_pair():
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.choice([7, 8]))) for _ in range(90)})
    found = {(words[i], words[j]) for x, y in spelling.single_edits(words, words, 8, True) for i, j in zip(x, y)}
    want = {(a, b) for a in words for b in words if one_edit(a, b) and max(len(a), len(b)) == 8}
    assert found == want
    left, right = spelling.matrices(["ab", "abc"], 3)
    assert np.array_equal(left[0], [97, 98, 0]) and np.array_equal(right[0], [0, 97, 98])
