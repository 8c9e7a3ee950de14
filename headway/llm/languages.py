"""Language identification by bit-sliced Bloom filters of character n-grams.

Counts of all training documents say in which languages an n-gram is at home: those in which its share of the n-grams is
at least ``HOME`` times its largest share in any language. Each language has a Bloom filter of its most frequent n-grams.
The filters are kept bit-sliced: row i holds bit i of every language's filter, so the AND of the few rows an
n-gram hashes to is the set of all languages that know it. A document's n-grams are looked up once; the counts per
language, less what a filter of that density finds by chance, decide.

Defined results: a null text and one without a letter is ``und`` with score 0, as is every text if nothing was learned;
texts in whose n-grams no language is found beyond chance get the language with the most training documents and score 0; a tie goes
to the language with more training documents, then to the smaller name; repeated rows are predicted each. Documents without
id are never learned from nor held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.session import settle

#: Lengths of the n-grams; n-grams in a language's filter at most, the most frequent ones; least occurrences of one.
SIZES = (2, 3, 4)
PROFILE = 50_000
LEAST = 3
#: Part of its largest share that an n-gram needs to be at home in a language.
HOME = 0.5
#: Rows of a filter for each n-gram in the fullest one, and rows an n-gram hashes to.
ROWS_EACH = 16
HASHES = 3
#: Characters worked on at once.
SLICE = 400_000

GRAMS = "lang string, gram long, n long"


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    #: (rows, languages / 64) words of bits
    rows: np.ndarray = field(default_factory=lambda: np.zeros((1, 1), np.uint64))
    #: chance that a filter knows an n-gram that isn't in it
    chance: np.ndarray = field(default_factory=lambda: np.zeros(0))


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by 5: such documents are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


# ------------------------------------------------------------------ n-grams
#: Letters, by code point; code points beyond the table's end are asked for one by one.
TABLE = np.array([chr(c).isalpha() for c in range(0x3000)])


def letters(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    inside = codes < len(TABLE)
    out = TABLE[np.where(inside, codes, 0)] & inside
    if not inside.all():
        far, at = np.unique(codes[~inside], return_inverse=True)
        out[~inside] = np.array([chr(c).isalpha() for c in far], bool)[at]
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram, text) of lower-cased texts whose other characters are blanks, and which texts have letters.

    An n-gram is up to four code points of 16 bits, so those beyond the 65,536th count modulo that. No n-gram has a blank inside.
    """
    lowered = [t.lower() + " " for t in texts]
    codes = np.frombuffer((" " + "".join(lowered)).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) + (not i) for i, t in enumerate(lowered)])
    real = letters(codes)
    has = np.zeros(len(texts), bool)
    has[owner[real]] = True
    blank = ~real
    keep = real | np.append(True, real[:-1])  # one blank between words
    codes, owner, blank = np.where(blank, 0x20, codes)[keep].astype(np.int64) & 0xFFFF, owner[keep], blank[keep]
    found, of = [], []
    for n in SIZES:
        if len(codes) < n:
            continue
        m = len(codes) - n + 1
        gram = np.zeros(m, np.int64)
        fits = np.ones(m, bool)
        for k in range(n):
            gram = gram << 16 | codes[k:k + m]
            if 0 < k < n - 1:
                fits &= ~blank[k:k + m]
        fits &= (owner[:m] == owner[n - 1:]) | blank[:m]
        found.append(gram[fits])
        of.append(owner[n - 1:][fits])
    return (np.concatenate(found) if found else np.zeros(0, np.int64), np.concatenate(of) if of else np.zeros(0, np.int64), has)


def slices(texts: list[str], size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` characters; a longer text is a range of its own."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield at, i
            at, held = i, 0
        held += len(t)
    if at < len(texts):
        yield at, len(texts)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of docs(lang, text)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            texts = batch.column("text").to_pylist()
            names = sorted(set(langs))
            for name in names:
                own = [t for t, lang in zip(texts, langs) if lang == name]
                for a, b in slices(own):
                    gram, n = np.unique(grams(own[a:b])[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name]).take(pa.array(np.zeros(len(gram), np.int32))), pa.array(gram), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    return docs.select("lang", "text").mapInArrow(count, GRAMS).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


# ------------------------------------------------------------------ filters
def places(gram: np.ndarray, size: int) -> list[np.ndarray]:
    """The rows an n-gram hashes to; ``size`` is a power of two."""
    h = gram.astype(np.uint64)
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    h = h ^ h >> np.uint64(33)
    mask, step = np.uint64(size - 1), h >> np.uint64(32) | np.uint64(1)
    return [(h + np.uint64(k) * step & mask).astype(np.int64) for k in range(HASHES)]


def build(langs: list[str], profiles: dict[str, np.ndarray]) -> Model:
    """The bit-sliced filters of the languages' n-grams."""
    size = 1 << 10
    while size < ROWS_EACH * max([1, *map(len, profiles.values())]):
        size *= 2
    rows = np.zeros((size, (len(langs) + 63) // 64), np.uint64)
    density = np.zeros(len(langs))
    for i, lang in enumerate(langs):
        on = np.zeros(size, bool)
        for at in places(profiles.get(lang, np.zeros(0, np.int64)), size):
            on[at] = True
        rows[on, i // 64] |= np.uint64(1 << i % 64)
        density[i] = on.mean()
    return Model(langs, rows, density ** HASHES)


def fit(docs: DataFrame) -> Model:
    """The filters, from all documents that have an id and a language and aren't held out."""
    known = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select(F.col("lang").cast("string").alias("lang"), "text")
    langs = [r["lang"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").collect()]
    if not langs:
        return Model()
    counts = settle(gram_counts(known))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.filter(F.col("n") >= LEAST).join(F.broadcast(totals), "lang").withColumn("share", F.col("n") / F.col("total"))
    largest = shares.groupBy("gram").agg(F.max("share").alias("most"))
    home = shares.join(largest, "gram").filter(F.col("share") >= HOME * F.col("most"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = home.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= PROFILE).select("lang", "gram").toArrow()
    of, gram = np.array(top["lang"].to_pylist(), object), top["gram"].to_numpy()
    return build(langs, {lang: gram[of == lang] for lang in langs})


# ------------------------------------------------------------------ prediction
def decide(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    gram, of, has = grams(texts)
    found = model.rows[0]
    for k, at in enumerate(places(gram, len(model.rows))):
        found = model.rows[at] if k == 0 else found & model.rows[at]
    total = np.bincount(of, minlength=len(texts)).astype(float)
    known = np.empty((len(texts), len(model.langs)))
    for i, chance in enumerate(model.chance):
        bits = found[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)
        known[:, i] = np.maximum(0, (np.bincount(of, bits, len(texts)) - chance * total) / (1 - chance))
    best = known.argmax(1)
    sure = known.max(1) / np.maximum(known.sum(1), 1e-9)
    return [model.langs[b] if h else "und" for b, h in zip(best, has)], np.where(has, sure, 0.0)


def predict(text: Column, model: Model) -> Column:
    """Struct of lang_pred and score."""
    if not model.langs:
        return F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, names, scores = batch.tolist(), [], [np.zeros(0)]
            for a, b in slices(texts):
                lang, score = decide(model, texts[a:b])
                names += lang
                scores.append(score)
            yield pd.DataFrame({"lang_pred": names, "score": np.concatenate(scores)})

    return predicted(F.coalesce(text, F.lit("")))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    return (docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text"), fit(docs)).alias("found"))
            .select("doc_id", "held_out", "found.lang_pred", "found.score"))
