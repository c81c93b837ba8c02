"""The quality classifier (12): its word vectors against a plain sum, its parts one by one, and its accuracy on documents held out."""

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxdose.llm import classifier as c
from voxdose.llm import entries

MIDDLE = "/root/testdata/sf0.01"
TEXTS = ["The cat sat on the mat.", "the cat -- sat", "", None, "Zebra " * 30, "a\tb\nc d", "x", "Ünïcode words ça va? 漢字 𝔘!!"]


def frame(spark, texts, parts=3):
    return spark.createDataFrame([(n, t, "clash") for n, t in enumerate(texts)], "doc_id bigint, text string, score string").repartition(parts)


def plain_vectors(texts):
    near, count = defaultdict(lambda: np.zeros(c.SIZE)), defaultdict(int)

    def index(word):
        out = np.zeros(c.SIZE)
        for place, sign in c._entries(pd.util.hash_array(np.array([word], dtype=object))):
            out[place[0]] += sign[0]
        return out

    row = lambda word: int(c._row(pd.util.hash_array(np.array([word], dtype=object)))[0])
    for t in texts:
        words = c.WORD.findall(t or "")
        for n, w in enumerate(words):
            count[row(w)] += 1
            for m in range(max(0, n - c.WINDOW), min(len(words), n + c.WINDOW + 1)):
                if m != n:
                    near[row(w)] += index(words[m])
    raw, counts = np.zeros((c.ROWS, c.SIZE)), np.zeros(c.ROWS)
    for r, v in near.items():
        raw[r] = v
    for r, n in count.items():
        counts[r] = n
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    share = counts / counts.sum()
    u = unit(raw)
    return unit(u - (u * share[:, None]).sum(axis=0)), c.SMOOTH / (c.SMOOTH + share)


def test_word_vectors(spark):
    vectors, weights = c.word_vectors(frame(spark, TEXTS))
    want, want_weights = plain_vectors(TEXTS)
    assert np.allclose(vectors, want, atol=1e-5) and np.allclose(weights, want_weights)
    again, _ = c.word_vectors(frame(spark, TEXTS, 1))
    assert (again == vectors).all()


def test_pooling(monkeypatch):
    rng = np.random.default_rng(1)
    vectors, weights = rng.normal(size=(c.ROWS, c.SIZE)).astype(np.float32), rng.random(c.ROWS)
    texts = [t or "" for t in TEXTS] + ["long text of words " * 400, "w"]
    got = c.pooled(iter(texts), vectors, weights)
    for t, x in zip(texts, got, strict=True):
        rows = c._row(pd.util.hash_array(np.array(c.WORD.findall(t), dtype=object))) if t else np.zeros(0, int)
        v, w, n = vectors[rows].astype(float), weights[rows], max(1, len(rows))
        mean = (v * w[:, None]).sum(axis=0) / max(w.sum(), 1e-12)
        steps = [sum(v[i] @ v[i + s] for i in range(len(rows) - s)) / n for s in (1, 2)]
        assert np.allclose(x, [*mean, np.linalg.norm(mean), w.sum() / n, *steps, np.log1p(len(rows))], atol=1e-4)
    # alone, among others, and in other pieces at once: the same row
    alone = np.concatenate([c.pooled(iter([t]), vectors, weights) for t in texts])
    assert (alone == got).all()
    monkeypatch.setattr(c, "CHUNK", 8)
    assert np.allclose(c.pooled(iter(texts), vectors, weights), got, atol=1e-9)


def test_network():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 6))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(3000) < 0.1)).astype(int)  # not linear, a tenth of the labels wrong
    net = c.fit_network(x[:2000], y[:2000], np.arange(2000) % 4 == 0)
    p = net.probability(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.8
    bins = np.minimum((p * 5).astype(int), 4)  # calibrated: where it says p, about a share p is right
    assert sum(abs((p[bins == n] - y[2000:][bins == n]).sum()) for n in range(5)) / 1000 < 0.08
    loss = lambda q: -np.mean(np.where(y[2000:], np.log(q), np.log(1 - q)))
    assert loss(p) <= loss(net._replace(temperature=0.3).probability(x[2000:]))


@pytest.fixture(scope="module")
def scores(spark):
    return entries.queries()["op12_quality_classifier"](spark, MIDDLE).toPandas()


def test_held_out(spark, scores):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").toPandas()
    assert sorted(scores["doc_id"]) == sorted(docs["doc_id"]) and list(scores.columns) == ["doc_id", "held_out", "score", "predicted"]
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(scores["doc_id"], scores["held_out"], strict=True))
    assert ((scores["score"] >= 0.3).astype(int) == scores["predicted"]).all() and scores["score"].between(0, 1).all()
    held = scores[scores["held_out"]].merge(spark.read.parquet(f"{MIDDLE}/labels.parquet").toPandas(), on="doc_id")
    assert (held["predicted"] == held["quality"]).mean() > 0.93
    assert held[held["quality"] == 1]["score"].mean() > held[held["quality"] == 0]["score"].mean() + 0.5


def test_labels_held_out_are_not_read(spark, scores):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(c.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    turned = turned.unionByName(spark.createDataFrame([(None, 1, 0), (3, None, None), (10**9, 0, 0)], "doc_id bigint, quality int, toxic int"))
    odd = docs.select("doc_id", "text", F.lit(1).alias("held_out")).repartition(7)
    again = c.op12(odd, turned).toPandas().sort_values("doc_id")
    assert np.allclose(again["score"], scores.sort_values("doc_id")["score"], atol=1e-6)


def test_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert c.op12(frame(spark, []), none).collect() == []
    rows = c.op12(frame(spark, TEXTS), none).collect()
    assert {(r["score"], r["predicted"]) for r in rows} == {(0.5, 1)} and len(rows) == len(TEXTS)
    one = c.op12(frame(spark, TEXTS), spark.createDataFrame([(n, 0) for n in range(9)], "doc_id bigint, quality int")).collect()
    assert len({r["score"] for r in one}) == 1 and one[0]["score"] < 0.3
    texts = ["good plain words here", "### $$$ %%%", None, ""] * 30
    labels = spark.createDataFrame([(n, n % 2 ^ 1) for n in range(120)], "doc_id bigint, quality int")
    docs = frame(spark, texts).unionByName(spark.createDataFrame([(None, "good plain words here", "z"), (4, "repeated row", "z"), (5, "### " * 40_000, "z")], "doc_id bigint, text string, score string"))
    rows = c.op12(docs, labels).collect()
    assert len(rows) == 123 and all(0 <= r["score"] <= 1 for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [True]
    assert np.mean([r["score"] for r in rows if r["doc_id"] in range(0, 120, 4)]) > np.mean([r["score"] for r in rows if r["doc_id"] in range(1, 120, 4)]) + 0.3
