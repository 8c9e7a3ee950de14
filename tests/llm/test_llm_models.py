"""Trained operators on held-out rows, and the pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from headway.llm import pseudo_lm, toxicity

FOLDER = "/root/testdata/sf0.01"


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    got = toxicity.judge(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").toPandas()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.itertuples())
    held = got[got.held_out]
    assert held[held.toxic == 1].predicted.mean() >= 0.5 and held[held.toxic == 0].predicted.mean() <= 0.05
    assert held[held.toxic == 1].score.mean() > 3 * held[held.toxic == 0].score.mean()


def test_held_out_labels_do_not_change_scores(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, flipped)


def test_network_prefers_real_order(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    model = pseudo_lm.fit(docs.filter("doc_id % 5 <> 0"))
    assert np.allclose(np.exp(model.table).sum(axis=1), 1, atol=1e-4)
    rng = random.Random(1)
    real, mixed = [], []
    for r in docs.filter("doc_id % 5 = 0").collect():
        words = (r.text or "").split()
        if len(words) > 30:
            real.append((r.doc_id, " ".join(words)))
            rng.shuffle(words)
            mixed.append((r.doc_id, " ".join(words)))
    a = pseudo_lm.score(spark.createDataFrame(real, "doc_id long, text string"), model).toPandas().set_index("doc_id")
    b = pseudo_lm.score(spark.createDataFrame(mixed, "doc_id long, text string"), model).toPandas().set_index("doc_id")
    assert (a.log_likelihood > b.log_likelihood.loc[a.index]).mean() > 0.6


def test_contexts_see_both_sides():
    c = np.array([1, 2, 3])
    n = pseudo_lm.contexts(c)
    assert len(set(n)) == 3 and n.max() < pseudo_lm.CONTEXTS
    assert pseudo_lm.contexts(np.array([1, 5, 3]))[1] == n[1]  # the token itself is masked
    assert pseudo_lm.contexts(np.array([], dtype=int)).size == 0


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = docs.count()
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        counts.append(docs.count())
    assert before > counts[0] > counts[1] >= counts[2] > counts[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.select("doc_id").distinct().count() == counts[3]


@pytest.mark.parametrize("n", range(len(corpus_pipeline.STAGES)))
def test_stages_take_odd_rows(spark, n):
    text = " ".join(f"w{i}" for i in range(60))
    schema = "doc_id long, text string, h string, n long, cls string, row int, _run_doc string, _hit_doc string, _removed string, removed int"
    rows = [(1, text, "x", 1, None, 1), (1, text, "x", 1, None, 1), (None, text, None, None, "c", 2), (None, None, None, None, None, None), (2, "", "y", 0, "", 3), (3, text.replace("w", "v") * 200, "z", 2, "d", 4)]
    stage = corpus_pipeline.STAGES[n][1]
    out = stage(spark, spark.createDataFrame([r + ("y", "z", None, 5) for r in rows], schema), FOLDER)
    kept = {r.doc_id for r in out.collect()}
    assert {2, 3} <= kept and None in kept
    assert stage(spark, spark.createDataFrame([], schema), FOLDER).count() == 0


def labelled_rows(spark):
    docs = [(i, f"{'vile gröttig scorn' if i % 3 == 0 else 'plain kindly words'} number{i} said item{i % 7} again") for i in range(90)]
    docs += [(5, None), (6, docs[6][1]), (500, "nobody labelled this")]
    labels = [(i, int(i % 3 == 0)) for i in range(90)] + [(4, 0), (None, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_training_texts_stay_off_the_driver(spark, monkeypatch):
    docs, labels = labelled_rows(spark)
    kind = type(docs)
    collected = []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: collected.append(self.columns) or collect(self))
    assert toxicity.fit(docs, labels).weights is not None
    assert collected and not any({"text", "doc_id"} & set(columns) for columns in collected)


def test_toxicity_dictionaries_hold_the_words_of_plain_counting(spark):
    docs, labels = labelled_rows(spark)
    held = {r[0] for r in labels.filter(toxicity.held_out(F.col("doc_id"))).select("doc_id").collect()}
    label = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id is not None and r.doc_id not in held}
    contexts = {0: set(), 1: set()}
    for r in docs.collect():
        if r.text is not None and r.doc_id in label:
            words = ["", *toxicity.WORD.findall(r.text.lower()), ""]
            contexts[label[r.doc_id]] |= set(zip(words, words[1:], words[2:]))
    usual = Counter(c[1] for c in contexts[0] - contexts[1])
    model = toxicity.fit(docs, labels)
    telling = set(model.toxic.decode().split())
    assert {"vile", "gröttig", "scorn"} >= telling > set()
    assert model.ordinary.decode().split() == [w for w, _ in sorted(usual.items(), key=lambda kv: (kv[1], kv[0])) if len(w) > 3 and w not in telling]
