"""Phrase collocations against brute force."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from headway.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER))]


def counted(rows, depth):
    f = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        for words in pieces(text):
            for k in range(1, depth + 1):
                f[lang or "und"].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    return f


def mined(rows, depth, least, top, inside=50):
    out = {}
    for lang, f in counted(rows, depth).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            longer = [c for q, c in f.items() if len(q) > len(p) and c >= least and any(q[i:i + len(p)] == p for i in range(len(q)))]
            if longer and 100 * max(longer) >= inside * a:
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]], n))
        for rank, (s, a, p, left, right, n) in enumerate(sorted(found)[:top], 1):
            out[lang, rank] = (p.decode(), -a, left, right, n, -s)
    return out


def asked(df):
    return {(r.lang, r.rank): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


def some_rows(n=250):
    rng = random.Random(4)
    words = ["a", "B", "the", "Lake", "é", "x-y", "\x00", "\x1f", " ", "naïve", "c'", "d1", "ÀB"]
    rows = [(rng.choice(["en", "fr", None]), "".join(rng.choice(words[: rng.randrange(2, 14)]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r", "\x0b"]) for _ in range(rng.randrange(60)))) for _ in range(n)]
    return rows + [("en", None), ("en", ""), (None, None), ("en", "..!?\n"), ("de", "one two"), ("en", "the lake " * 3000)]


@pytest.mark.parametrize("depth,size", [(3, 16_000_000), (3, 300), (4, 300)])
def test_phrases_equal_brute_force(spark, depth, size):
    rows = some_rows()
    docs = spark.createDataFrame([(i, lang, text, "x", 1) for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, phrase string, n int")
    got = asked(collocations.mine(docs, depth=depth, least=10, top=25, size=size))
    want = mined(rows, depth, 10, 25)
    assert got == want and len(want) > 40


def test_counts_beyond_64_bits_and_ties_after_flooring(spark):
    big = 3_000_000_000_000
    rows = [("en", 0, "", 10 * big), ("en", 1, "p", 2 * big + 1), ("en", 1, "q", 2 * big), ("en", 1, "s", 5), ("en", 2, "p q", 2 * big - 1), ("en", 2, "q s", 10), ("en", 3, "p q s", 10)]
    counts = spark.createDataFrame(rows, "lang string, length int, phrase string, n long")
    got = {r.phrase: r for r in collocations.scored(counts).collect()}
    assert got["p q"].score == 1_000_000 * (2 * big - 1) ** 2 // ((2 * big + 1) * 2 * big)
    assert got["p q s"].score == min(1_000_000 * 100 // ((2 * big + 1) * 10), 1_000_000 * 100 // ((2 * big - 1) * 5)) == 0
    assert got["p q s"].l == 2 * big + 1  # both cuts score 0: the first counts
    assert "q s" not in got


def test_index_intervals_count_every_phrase():
    rng = np.random.default_rng(7)
    text = np.concatenate([[0], rng.integers(0, 6, 400), [0]])
    seen = {}
    for phrases, n in collocations.Both(text, 6).levels(lambda p: np.ones(len(p), bool)):
        seen |= {tuple(map(int, p)): int(c) for p, c in zip(phrases, n)}
    want = collections.Counter()
    for k in range(1, 7):
        want.update(w for i in range(len(text) - k + 1) if 0 not in (w := tuple(map(int, text[i:i + k]))))
    assert seen == dict(want)


def test_shards_are_cut_between_pieces():
    texts = pa.array([b"ab cd. ef", b"", b"gh", b"ij, kl mn op qr st uv"], pa.large_binary())
    for size in (1, 4, 7, 100):
        assert pieces_of(texts, size) == [b"ab cd", b"ef", b"gh", b"ij", b"kl mn op qr st uv"]


def pieces_of(texts, size):
    pieces_seen = []
    for data, first in collocations.shards(texts, size):
        text, names = collocations.symbols(data, first)
        run = []
        for s in text:
            if s:
                run.append(names[int(s) - 1].as_py())
            elif run:
                pieces_seen.append(b" ".join(run))
                run = []
    return pieces_seen


def test_filter_loses_nothing(spark):
    rows = [("en", f"w{i} v{i}") for i in range(5000)]
    bits = collocations.filter_bits(spark.createDataFrame(rows, "lang string, phrase string"))
    hashed = lambda phrases: [collocations.word_hashes([w.encode() for w in c]) for c in zip(*(p.split(" ") for p in phrases))]
    assert collocations.passes(bits, "en", hashed([p for _, p in rows])).all()
    assert collocations.passes(bits, "en", hashed([f"x{i} y{i}" for i in range(5000)])).mean() < 0.05


def test_no_rows(spark):
    assert collocations.mine(spark.createDataFrame([], "doc_id long, lang string, text string")).collect() == []
