"""Masked pseudo-likelihood scores from a bidirectional window network.

Every token is predicted from both sides: its probability is P(class | two tokens before, two after) times
P(word | class). Words are hashed to buckets and buckets cut into classes of near equal mass by their counts in the
whole corpus. The network embeds the four neighbours (the outer ones by coarse classes), adds them up, and gives class
probabilities through a hidden layer. Its likelihood of the corpus depends on window counts alone, so tasks fold all
documents into those counts and numpy trains on them: every document takes part, and what is trained on has at most
contexts x classes numbers. The trained network is evaluated once for every context; documents are scored by look-up.

Defined results: null and empty texts have no tokens, a log-likelihood of 0 and no mean; edges of a text are a class
of their own; repeated rows are counted and scored each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of words, classes, coarse classes of the outer neighbours, width of the hidden layer, training steps.
BUCKETS = 1 << 18
CLASSES = 32
COARSE = 3
HIDDEN = 24
STEPS = 300
#: Added to every bucket's count, so that unseen words have a probability.
SMOOTH = 0.5
#: Words whose hashes are kept at hand in a task; the store is emptied when full. It changes speed only.
WORDS_KEPT = 500_000


@dataclass
class Model:
    class_of: np.ndarray  # class of a bucket
    word_logp: np.ndarray  # log P(bucket | class)
    table: np.ndarray  # log P(class | context), one row per context


def tokenizer():
    """A function from text to the buckets of its words (lower-cased A-Z, parted by white space)."""
    import xxhash

    known: dict[bytes, int] = {}

    def buckets(text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if len(known) > WORDS_KEPT:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w) % BUCKETS
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))

    return buckets


def contexts(classes: np.ndarray) -> np.ndarray:
    """Number of the context of every token: (outer left, left, right, outer right), edges included."""
    coarse = np.append(np.arange(CLASSES) * COARSE // CLASSES, COARSE)
    padded = np.concatenate([[CLASSES, CLASSES], classes, [CLASSES, CLASSES]])
    n = len(classes)
    number = coarse[padded[:n]]
    for inner in (padded[1:n + 1], padded[3:n + 3]):
        number = number * (CLASSES + 1) + inner
    return number * (COARSE + 1) + coarse[padded[4:n + 4]]


CONTEXTS = (COARSE + 1) ** 2 * (CLASSES + 1) ** 2


def _folded(docs: DataFrame, class_of: np.ndarray | None) -> pd.DataFrame:
    """Counts (key, n) over all tokens: of buckets, or with classes of (context, class) windows."""
    sent = docs.sparkSession.sparkContext.broadcast(class_of)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets = tokenizer()
        classes = sent.value
        size = BUCKETS if classes is None else CONTEXTS * CLASSES
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            held, waiting = [], 0
            for text in batch["text"]:
                b = buckets(text)
                if not len(b):
                    continue
                if classes is None:
                    held.append(b)
                else:
                    c = classes[b]
                    held.append(contexts(c) * CLASSES + c)
                waiting += len(b)
                if waiting > size:
                    total += np.bincount(np.concatenate(held), minlength=size)
                    held, waiting = [], 0
            if held:
                total += np.bincount(np.concatenate(held), minlength=size)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 100_000):
            yield pd.DataFrame({"key": at[i:i + 100_000], "n": total[at[i:i + 100_000]]})

    counts = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInPandas(fold, "key long, n long")
    return counts.groupBy("key").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS or CONTEXTS * CLASSES rows


def train(counts: np.ndarray, steps: int = STEPS, seed: int = 5) -> np.ndarray:
    """log P(class | context) for all contexts, from the (contexts x classes) window counts.

    Full-batch Adam on the mean log-likelihood; hidden = tanh(sum of the four embeddings).
    """
    sizes = [COARSE + 1, CLASSES + 1, CLASSES + 1, COARSE + 1]
    parts = np.array(np.unravel_index(np.arange(CONTEXTS), sizes))
    seen = np.flatnonzero(counts.sum(axis=1))
    target = counts[seen] / max(1, counts.sum())
    weight = target.sum(axis=1, keepdims=True)
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.3, (s, HIDDEN)) for s in sizes] + [rng.normal(0, 0.3, (HIDDEN, CLASSES)), np.zeros(CLASSES)]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]

    def forward(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(sum(params[j][parts[j, at]] for j in range(4)))
        z = hidden @ params[4] + params[5]
        z -= z.max(axis=1, keepdims=True)
        return hidden, z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    for step in range(1, steps + 1 if len(seen) else 1):
        hidden, logp = forward(seen)
        delta = np.exp(logp) * weight - target
        back = (delta @ params[4].T) * (1 - hidden ** 2)
        grads = []
        for j in range(4):
            g = np.zeros_like(params[j])
            np.add.at(g, parts[j, seen], back)
            grads.append(g)
        grads += [hidden.T @ delta, delta.sum(axis=0)]
        rate = 0.05 * (1 - step / (steps + 1))
        for p, g, m, v in zip(params, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
    return forward(np.arange(CONTEXTS))[1]


def fit(docs: DataFrame, steps: int = STEPS) -> Model:
    """Train on all documents: one pass for word counts, one for window counts."""
    words = _folded(docs, None)
    count = np.zeros(BUCKETS, dtype=np.int64)
    count[words["key"].to_numpy("int64")] = words["n"].to_numpy("int64")
    order = np.lexsort((np.arange(BUCKETS), -count))
    mass = np.cumsum(count[order])
    class_of = np.empty(BUCKETS, dtype=np.int64)
    class_of[order] = np.minimum((mass - count[order]) * CLASSES // max(1, mass[-1]), CLASSES - 1)
    smooth = count + SMOOTH
    mass_of = np.bincount(class_of, weights=smooth, minlength=CLASSES)
    word_logp = np.log(smooth) - np.log(mass_of[class_of])
    windows = _folded(docs, class_of)
    counts = np.zeros(CONTEXTS * CLASSES)
    counts[windows["key"].to_numpy("int64")] = windows["n"].to_numpy("float64")
    return Model(class_of, word_logp.astype(np.float32), train(counts.reshape(CONTEXTS, CLASSES), steps).astype(np.float32))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum over tokens), mean_log_likelihood."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size depends on the parameters above only
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets = tokenizer()
        m = sent.value
        for batch in batches:
            n, total = [], []
            for text in batch["text"]:
                b = buckets(text)
                c = m.class_of[b]
                n.append(len(b))
                total.append(float(m.table[contexts(c), c].sum(dtype=np.float64) + m.word_logp[b].sum(dtype=np.float64)) if len(b) else 0.0)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": n, "log_likelihood": total})

    kind = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL("n_tokens long, log_likelihood double").fields])
    return rows.mapInPandas(judge, kind).withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))


def judge(docs: DataFrame) -> DataFrame:
    """Scores of all documents under a model of all documents."""
    return score(docs, fit(docs))
