import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest

from weftgraph.llm import langmodel

SF = "/root/testdata/sf0.001"


def words(text):
    return (text or "").encode().lower().split() + [b""]


def brute_base(rows):
    train = Counter(w for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for w in words(t))
    n, v = sum(train.values()), len(train)
    return n, [(i, len(words(t)), sum(train[w] > 0 for w in words(t)), sum(math.log10((train[w] + 1) / (n + v + 1)) for w in words(t))) for i, t in rows]


def check(got, rows):
    n, want = brute_base(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    assert {r.train_tokens for r in got} <= {n}
    for a, b in zip(sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got), key=key), sorted(want, key=key), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-6 * max(1, abs(b[3]))


def test_edge_rows(spark):
    rows = [(i, t) for i, t in enumerate(["", None, "A b a", "a é É", "x " * 9000, "a b", "a b"])] + [(None, "a zz"), (3, "a zz")]
    got = langmodel.scores(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, word int")).collect()
    check(got, rows)
    assert all(r.score < 0 for r in got)
    assert langmodel.scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def weighted(model, seed=1):
    return np.random.default_rng(seed).normal(size=model.no_weights().shape).astype(np.float32)


@pytest.mark.parametrize("n", [0, 1, 5, 70, 400])
def test_the_model_is_a_distribution(n):
    """Over all known words and one unknown, whatever the weights and the words before."""
    c = np.sort(np.random.default_rng(n).integers(1, 200, n))[::-1]
    rare_tokens, rare_distinct = 60, 20
    model = langmodel.Model([b"w%d" % k for k in range(n)], c, int(c.sum()) + rare_tokens, n + rare_distinct).prepare()
    assert model.rare_mass == rare_tokens + rare_distinct + 1
    weights = weighted(model)
    for before in ([], [3], [3, 1], [(1 << 32) + 5, 2]):
        total = 0.0
        for leaf in [*range(n), -1]:
            ids, context = np.array([*before, leaf]), np.array([*before, leaf])
            ids[:-1] = -1
            total += 10 ** model.log10_tokens(weights, ids, model.features(context, np.array([0])))[-1]
        assert abs(total - 1) < 1e-4
    if n:  # without weights: the add-one base
        ids = np.arange(n)
        got = model.log10_tokens(model.no_weights(), ids, model.features(ids, np.array([0])))
        assert np.allclose(got, np.log10((c + 1) / (c.sum() + n + rare_tokens + rare_distinct + 1)), atol=1e-4)


def test_code_tree():
    for n in (1, 2, 3, 15, 16, 17, 31, 500):
        mass = sorted(np.random.default_rng(n).geometric(0.02, n).tolist(), reverse=True)
        start, node, branch, bias = langmodel.code_tree(mass)
        codes = {tuple(zip(node[a:b].tolist(), branch[a:b].tolist(), strict=True)) for a, b in zip(start[:-1], start[1:], strict=True)}
        assert len(codes) == n
        for k in range(n):  # the shares along a code multiply to the leaf's
            assert abs(np.exp(bias[node[start[k] : start[k + 1]], branch[start[k] : start[k + 1]]].sum()) - mass[k] / sum(mass)) < 1e-5


def test_counts_by_brute_force():
    model = langmodel.Model([b"a", b"b", b"c"], np.array([9, 5, 2]), 20, 5).prepare()
    model.rows = 64
    weights = weighted(model)
    ids, context, first, rare = model.encode([b"a b zz c", b"", b"b a"])
    assert rare == [[b"zz", b""], [b""], [b""]] and first.tolist() == [0, 5, 6]
    observed, expected = np.zeros((langmodel.FAN, 64)), np.zeros((langmodel.FAN, 64))
    model.count(weights, ids, model.features(context, first), observed, expected)
    token, node, branch, rows = model.decisions(ids, model.features(context, first))
    o, e = np.zeros((64, langmodel.FAN)), np.zeros((64, langmodel.FAN))
    for k in range(len(token)):
        z = model.bias[node[k]].astype(float) + sum(weights[r] for r in rows[:, k])
        for r in rows[:, k]:
            o[r, branch[k]] += 1
            e[r] += np.exp(z) / np.exp(z).sum()
    assert np.array_equal(observed, o.T) and np.allclose(expected, e.T, atol=1e-4)


def texts(n, seed=2):
    rnd = np.random.default_rng(seed)
    return [(k, " ".join(f"w{x}" for x in np.minimum(rnd.geometric(0.03, rnd.integers(0, 60)), 90))) for k in range(n)]


def test_held_out_texts_teach_nothing_and_the_split_does_not_matter(spark):
    rows = texts(240)
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    other = [(i, f"hot hot new{i} w1 " * 9 if i in held else t) for i, t in rows]
    score = lambda rows, parts: {r.doc_id: r.score for r in langmodel.scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()}
    one, seven, changed = score(rows, 1), score(rows[::-1], 7), score(other, 3)
    assert held and all(abs(one[i] - seven[i]) < 1e-4 for i in one)
    assert all(abs(one[i] - changed[i]) < 1e-4 for i in one if i not in held)


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
def test_whole_table_and_gain(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = langmodel.query(spark, SF).collect()
    check(got, rows)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_threshold_is_a_bound(spark):
    counts = spark.createDataFrame([(b"w%d" % k, 1 + k % 100) for k in range(5000)], "word binary, c long")
    for most in (1, 40, 777, 5000):
        least = langmodel.threshold(counts, most)
        assert counts.filter(f"c >= {least}").count() <= most
