import os
import zlib

import numpy as np
import pytest

from weftgraph.llm import quality

SF = "/root/testdata/sf0.01"


def walk(model, x):
    out = []
    for row in x:
        total = model.prior
        for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += v[node - len(f)]
        out.append(1 / (1 + np.exp(-total)))
    return np.array(out)


def test_flat_arrays_equal_a_walk_and_learn_an_interaction():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.3)).astype(float)
    model = quality.fit(x[:400], y[:400])
    assert np.allclose(model.score(x), walk(model, x))
    assert ((model.score(x[400:]) >= 0.5) == y[400:]).mean() > 0.93


def test_without_labels_of_both_kinds():
    assert quality.fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert quality.fit(np.zeros((50, 3)), np.ones(50)).score(np.zeros((1, 3)))[0] > 0.99


def test_statistics_of_odd_texts():
    for t in (b"", b"  \n", "é".encode(), b"\xff\xfe", b"a " * 100_000):
        got = quality.statistics(t)
        assert got.shape == (quality.N_STATISTICS,) and np.isfinite(got).all()


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
def test_held_out_accuracy(spark):
    rows = quality.query(spark, SF).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (1, "", 1), (None, "good words here", 1), (2, "x" * 300_000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 4
    assert quality.keep_good(docs.limit(0), labels.limit(0)).count() == 0
