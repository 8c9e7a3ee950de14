"""Toxicity by compression distance.

One zstandard dictionary is trained on toxic and one on ordinary text. A window of a text is compressed with either;
where the toxic dictionary makes it shorter, the window resembles toxic text. A document is scored by its most telling
windows, with a logistic curve calibrated on the training rows.

Labels belong to whole documents of which few windows are toxic, so the toxic dictionary is trained on telling words:
those whose log-likelihood ratio, counted over distinct three-word contexts so that copies count once, is significant.
The ordinary dictionary holds the words most frequent in ordinary text. A window is one word, written three times so
that even a short word outweighs the frame that compression adds. A window counts if the toxic dictionary compresses
it as well as its own words; that threshold, like the logistic curve, is calibrated on the training rows.

Defined results: null and empty texts have no windows and score like a text without signs; without labelled rows of
both kinds every score is 0; conflicting labels of one document count as toxic; repeated rows are scored each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.session import settle

#: Bound of the training sample: rows per label (in the order of a hash of the id), and characters in all.
TRAIN_ROWS = 2000
TRAIN_CHARS = 40_000_000
#: Tasks that the sample's texts are dealt to.
TRAIN_TASKS = 24
#: Size of a dictionary; least evidence of a telling word (a chance of about 1 in 100,000); copies of a word in a
#: window; telling windows averaged; share of the toxic dictionary's own words that the threshold lets pass.
DICTIONARY_BYTES = 16384
EVIDENCE = 20.0
COPIES = 3
TOP = 8
PASSING = 0.9
#: Words whose window lengths are kept at hand in a task; the store is emptied when full. It changes speed only.
WORDS_KEPT = 500_000

WORD = re.compile(r"[^\W_]+")


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    longest: int
    weights: tuple[float, ...] | None


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by 5: such labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _word_counts(sample: DataFrame) -> DataFrame:
    """word, a, b: its distinct contexts in toxic texts, and those in ordinary texts only."""
    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text, label in zip(batch["text"], batch["toxic"]):
                words = ["", *WORD.findall(text.lower()), ""]
                seen = set(zip(words, words[1:], words[2:]))
                if seen:
                    yield pd.DataFrame(list(seen), columns=["before", "word", "after"]).assign(toxic=int(label))

    found = sample.select("text", "toxic").mapInPandas(contexts, "before string, word string, after string, toxic int")
    return (found.groupBy("before", "word", "after").agg(F.max("toxic").alias("toxic"))
            .groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")))


def _telling(sample: DataFrame) -> tuple[list[str], list[str]]:
    """Toxic words, and as many ordinary words as a dictionary can hold, the strongest last."""
    counts = settle(_word_counts(sample))
    bad, good = (x or 0 for x in counts.agg(F.sum("a"), F.sum("b")).first())
    rate = bad / max(1, bad + good)

    @F.pandas_udf("double")
    def evidence(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, o in zip(a.tolist(), b.tolist()):
            expected = (x + o) * rate
            out.append(2 * (x * math.log(x / expected) + (o * math.log(o / (x + o - expected)) if o else 0)) if x > expected else 0.0)
        return pd.Series(out, dtype="float64")

    long = counts.filter(F.length("word") > 3).withColumn("evidence", evidence("a", "b"))
    chosen = long.filter(F.col("evidence") >= EVIDENCE).orderBy("evidence", "word").select("word").collect()
    # a word takes 5 bytes or more
    usual = (long.filter((F.col("evidence") < EVIDENCE) & (F.col("b") > 0)).orderBy(F.desc("b"), F.desc("word"))
             .select("word").limit(DICTIONARY_BYTES // 4).collect())
    return [r["word"] for r in chosen], [r["word"] for r in reversed(usual)]


def _content(words: list[str]) -> bytes:
    """The last words that fit, spaced like windows; zstandard does not look into the last bytes of a dictionary."""
    return (" " + " ".join(words) + " ").encode()[-DICTIONARY_BYTES:] + b" " * 16


def _compressor(content: bytes):
    """Window compression with a dictionary; lazy matching takes the longest match even in the shortest window."""
    import zstandard

    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    p = zstandard.ZstdCompressionParameters.from_level(19, min_match=4, strategy=zstandard.STRATEGY_BTLAZY2, target_length=32, write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress


def _window(word: str) -> bytes:
    return f" {word} ".encode() * COPIES


def measure(model: Model):
    """A function from text to its features: the most telling window's gain, the means of the best three and ``TOP``."""
    toxic, ordinary = _compressor(model.toxic), _compressor(model.ordinary)
    known: dict[str, int] = {}

    def gain(word: str) -> int:
        if len(known) >= WORDS_KEPT:
            known.clear()
        window = _window(word)
        length = len(toxic(window))
        g = len(ordinary(window)) - length if length <= model.longest else 0
        if len(word) <= 64:
            known[word] = g
        return g

    def features(text: str) -> tuple[float, float, float]:
        best: list[int] = []
        for word, n in Counter(WORD.findall(text.lower())).items():
            g = known.get(word)
            g = gain(word) if g is None else g
            if g > 0:
                best += [g] * min(n, TOP)
        best = sorted(best, reverse=True)[:TOP]
        return (float(best[0]) if best else 0.0, sum(best[:3]) / 3, sum(best) / TOP)

    return features


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Weights of a ridge logistic regression, by Newton steps."""
    full = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(full.shape[1])
    penalty = ridge * np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        step = np.linalg.solve(full.T @ (full * (p * (1 - p) + 1e-9)[:, None]) + penalty, full.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic: a bounded sample of the labelled rows that are not held out, each once."""
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    some = [known.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS) for value in (0, 1)]
    picked = settle(some[0].unionByName(some[1]))
    rows = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    ids = rows.select("doc_id", F.length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "n").limit(2 * TRAIN_ROWS)
    so_far = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "n").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    taken = ids.withColumn("so_far", so_far).filter(F.col("so_far") <= TRAIN_CHARS).select("doc_id").distinct()
    return settle(rows.join(F.broadcast(taken), "doc_id", "left_semi").repartition(TRAIN_TASKS, "doc_id", "text").dropDuplicates(["doc_id", "text"]))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on a bounded sample of the labelled rows that are not held out.

    Its texts stay in tasks; the driver gets the words of the dictionaries and three features of each row.
    """
    sample = training_rows(docs, labels)
    chosen, usual = _telling(sample)
    if not chosen:
        return Model(b"", b"", 0, None)
    toxic_words = _compressor(_content(chosen))
    lengths = sorted(len(toxic_words(_window(w))) for w in chosen)
    model = Model(_content(chosen), _content(usual), lengths[int(len(lengths) * PASSING)], None)

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = measure(model)
        for batch in batches:
            x = np.array([features(t) for t in batch["text"]]).reshape(-1, 3)
            yield pd.DataFrame({"x0": x[:, 0], "x1": x[:, 1], "x2": x[:, 2], "y": batch["toxic"].to_numpy(dtype=float)})

    rows = np.array(sample.orderBy("doc_id", "text").mapInPandas(told, "x0 double, x1 double, x2 double, y double").collect())
    return replace(model, weights=_logistic(rows[:, :3], rows[:, 3]))


def score(text: Column, model: Model) -> Column:
    """Score column, 0 to 1: higher where label 1 is likelier."""
    if model.weights is None:
        return F.lit(0.0)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = measure(model)
        w = np.array(model.weights)
        for texts in batches:
            x = np.array([features(t) for t in texts]).reshape(-1, 3)
            yield pd.Series(1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30))))

    return scores(F.coalesce(text, F.lit("")))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = fit(docs, labels)
    return (docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def keep_ordinary(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents that score below ``least``, with their columns."""
    return docs.filter(score(F.col("text"), fit(docs, labels)) < least)
