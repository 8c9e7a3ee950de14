"""Language identification: held-out accuracy, filters against sets, odd rows."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from headway.llm import languages

FOLDER = "/root/testdata/sf0.01"


def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = languages.judge(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.itertuples())
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() >= 0.98


def test_held_out_documents_teach_nothing(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    out = languages.held_out(F.col("doc_id"))
    other = docs.withColumn("lang", F.when(out, F.lit("xx")).otherwise(F.col("lang"))).withColumn("text", F.when(out, F.lit("qqq www")).otherwise(F.col("text")))
    a, b = languages.fit(docs), languages.fit(other)
    assert a.langs == b.langs and np.array_equal(a.rows, b.rows) and np.array_equal(a.chance, b.chance)


def test_slices_and_batches_change_nothing(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = languages.fit(docs)
    texts = [r.text or "" for r in docs.limit(80).collect()]
    whole, scores = languages.decide(model, texts)
    alone = [languages.decide(model, [t]) for t in texts]
    assert whole == [a[0][0] for a in alone] and np.allclose(scores, [a[1][0] for a in alone])


def test_grams_have_no_blank_inside_and_stay_in_their_text():
    def listed(texts):
        gram, of, has = languages.grams(texts)
        text = lambda g: "".join(chr(g >> 16 * k & 0xFFFF) for k in range(3, -1, -1) if g >> 16 * k)
        return sorted((int(o), text(int(g))) for g, o in zip(gram, of)), list(has)
    def by_hand(texts):
        out = []
        for i, t in enumerate(texts):
            words = "".join(c if c.isalpha() else " " for c in t.lower()).split()
            for w in words:
                w = f" {w} "
                out += [(i, w[a:a + n]) for n in languages.SIZES for a in range(len(w) - n + 1)]
        return sorted(out), [any(c.isalpha() for c in t) for t in texts]
    texts = ["Ab, c", "", "1 2", "ÀÉ d'e", "x", "...", "İi ß", "日本 語", "\U00010400\U00010401 z"]
    want, has = by_hand(texts)
    mod = lambda w: "".join(chr(ord(c) & 0xFFFF) for c in w)
    got, letters = listed(texts)
    assert letters == has and got == sorted((i, mod(w)) for i, w in want)


def test_filters_return_every_language_of_a_gram():
    rng = random.Random(2)
    langs = [f"l{i:02}" for i in range(70)]  # more than one word of bits
    sets = {lang: np.array(sorted(rng.sample(range(1, 20_000), rng.randrange(1, 900))), np.int64) for lang in langs}
    model = languages.build(langs, sets)
    every = np.arange(20_000, dtype=np.int64)
    found = model.rows[languages.places(every, len(model.rows))[0]]
    for at in languages.places(every, len(model.rows))[1:]:
        found = found & model.rows[at]
    for i, lang in enumerate(langs):
        known = (found[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(bool)
        inside = np.isin(every, sets[lang])
        assert known[inside].all()
        assert abs(known[~inside].mean() - model.chance[i]) < 0.01


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score double, found string"
    english, french = "the lake and the house of them", "le lac et les maisons sont belles"
    rows = [(i, english if i % 2 else french, "en" if i % 2 else "fr", 0.5, "x") for i in range(40)]
    rows += [(100, None, "en", None, None), (101, "", "fr", None, None), (102, "12 + 3!", None, None, None), (None, english, "zz", None, None), (1, english, "en", 1.0, None), (103, "the house " * 300_000, None, None, None), (104, "ЖЖЖЖ", None, None, None)]
    got = languages.judge(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and by_id[100].score == by_id[102].score == 0
    assert by_id[None].lang_pred == "en" and by_id[None].held_out is False  # rows without id teach nothing
    assert by_id[103].lang_pred == "en" and by_id[0].lang_pred == "fr"
    assert by_id[104].lang_pred in ("en", "fr") and by_id[104].score == 0
    assert languages.judge(spark.createDataFrame([], schema)).collect() == []
    untaught = languages.judge(spark.createDataFrame([(1, "a b", None, 0.0, "")], schema)).first()
    assert (untaught.lang_pred, untaught.score) == ("und", 0.0)
