"""Quality scores: held-out accuracy, the parts of the fit, awkward rows."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from trailmark.llm import queries, quality_scores as q

DOCS = "doc_id long, text string, lang string, score int"


def auc(score, label):
    good, bad = score[label == 1], score[label == 0]
    return (np.sign(good[:, None] - bad[None, :]) / 2 + 0.5).mean()


def test_held_out_accuracy(spark):
    got = queries.op12_fourier_quality(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    assert len(got) == 1000 and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got["doc_id"]]).all()
    assert (got["predicted"] == (got["score"] >= 0.3)).all()
    both = got[got["held_out"]].merge(labels, on="doc_id")
    assert len(both) > 60 and auc(both["score"].to_numpy(), both["quality"].to_numpy()) > 0.98
    assert (both["predicted"] == both["quality"]).mean() > 0.96


def small(spark, n=200):
    good, bad = "a calm river ran past the old stone mill in winter", "BUY!!! $$$ %%% NOW NOW NOW"
    rows = [(i, f"{good} number {i}" if i % 3 else f"{bad} {i}", "en", 1) for i in range(n)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(n)], "doc_id long, quality int")


def test_held_out_labels_change_nothing(spark):
    docs, labels = small(spark)
    turned = labels.selectExpr("doc_id", "if(pmod(crc32(cast(doc_id as string)), 5) = 0, 1 - quality, quality) as quality")
    a, b = ({r["doc_id"]: r["score"] for r in q.quality_scores(docs, some).collect()} for some in (labels, turned))
    assert a == b and a[1] > 0.9 > 0.1 > a[0]


def test_partitions_do_not_matter(spark):
    docs, labels = small(spark)
    a, b = ({r["doc_id"]: r["score"] for r in q.quality_scores(docs.repartition(n), labels).collect()} for n in (1, 5))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-3


def test_awkward_rows(spark):
    docs, labels = small(spark)
    more = spark.createDataFrame([(None, "no id", None, None), (500, None, None, 2), (501, "", "de", 3), (501, "again " * 30000, "de", 3), (502, "\x00\x01 é 日本", None, None)], DOCS)
    labels = labels.unionByName(spark.createDataFrame([(None, 1), (3, None), (4, 7)], "doc_id long, quality int"))
    got = q.quality_scores(docs.unionByName(more), labels, keep=["doc_id", "lang", "score"]).collect()
    assert len(got) == 205 and all(0 <= r["score"] <= 1 for r in got)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    empty = {r["score"] for r in got if r["doc_id"] in (500,)}
    assert len(empty) == 1
    assert q.quality_scores(docs.limit(0), labels).collect() == []


@pytest.mark.parametrize("labels,score", [([], 0.5), ([(1, 1), (2, 1)], 1.0), ([(1, 0)], 0.0)])
def test_without_both_labels(spark, labels, score):
    docs, _ = small(spark, 10)
    got = q.quality_scores(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert {r["score"] for r in got} == {score}


def test_isotonic_against_all_blocks():
    rng = np.random.default_rng(3)
    w, v = rng.integers(1, 5, 40).astype(float), rng.random(40)
    got = q.isotonic(w, v)
    best = [max(min(np.average(v[i:j + 1], weights=w[i:j + 1]) for j in range(k, 40)) for i in range(k + 1)) for k in range(40)]
    assert np.allclose(got, best)


def test_cosines_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(4)
    d = len(q.STATISTICS)
    x = rng.normal(size=(40, d)) * 0.7
    m = q.Model(np.zeros(d), np.ones(d), None, np.zeros(1), np.zeros(1))
    f = m.features(x)[:, :q.FEATURES]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * q.WIDTH**2))
    assert np.abs(f @ f.T - want).mean() < 0.06
