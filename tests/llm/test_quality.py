import zlib

import numpy as np
import pytest

from parcelight.llm import boosting, quality


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_boosting_learns_and_flattens():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosting.fit(x[:2000], y[:2000])
    assert auc(model.probability(x[2000:]), y[2000:]) > 0.97
    one = model.probability(x[2000:2001])
    assert one[0] == pytest.approx(model.probability(x[2000:])[0])
    empty = boosting.fit(np.zeros((0, 3)), np.zeros(0))
    assert empty.probability(np.ones((2, 3))) == pytest.approx([0.5, 0.5])


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = quality.query(spark, d).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert len(rows) == 1000
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    score, label = np.array(held).T
    assert auc(score, label) > 0.9


def test_labels_of_fold_0_and_other_columns_have_no_effect(spark, corpus):
    from pyspark.sql import functions as F

    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = corpus.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None).cast("string"))
    a, b = quality.train(corpus, labels), quality.train(other, flipped)
    assert (a.value == b.value).all() and (a.threshold == b.threshold).all()


def test_odd_rows(spark, make_docs):
    labels = spark.createDataFrame([(0, 1, 0), (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    docs = make_docs([None, "", "word " * 50_000, "a", "a"], [0, None, 2, 3, 3], score="old", predicted=9)
    rows = quality.score_quality(docs, quality.train(docs, labels)).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    nothing = make_docs([])
    assert quality.score_quality(nothing, quality.train(nothing, labels.limit(0))).collect() == []
    assert quality.train(docs, labels.limit(0)).probability(np.zeros((1, 29)))[0] == pytest.approx(0.5)
