import random

import numpy as np
import xxhash

from weftgraph.llm import simhash


def plain_fingerprint(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(fps, radius):
    n, label = len(fps), list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_set(rnd, n):
    fps = {0, 1, 2**64 - 1}
    while len(fps) < n:
        base = rnd.choice(sorted(fps)) if rnd.random() < 0.6 else rnd.getrandbits(64)
        for _ in range(rnd.randint(0, 6)):
            base ^= 1 << rnd.randrange(64)
        fps.add(base)
    return sorted(fps)


def test_index_equals_brute_force_within_a_bucket():
    rnd = random.Random(3)
    for n in (1, 2, 3, 5, 17, 300):
        fps = np.array(near_set(rnd, max(3, n))[:n], np.uint64)
        rank = fps.copy()
        for k in (1, 2, 4, 8, 16, 32):
            rank ^= rank >> np.uint64(k)
        fps = fps[np.argsort(rank)]
        got = simhash.GrayIndex(np.zeros(n, int), fps).components(4).tolist()
        assert got == brute(fps.tolist(), 4)


def test_dense_cluster_is_cheap_and_whole():
    rnd = random.Random(4)
    fps = np.array(sorted({sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 2))) for _ in range(3000)}), np.uint64)
    assert set(simhash.GrayIndex(np.zeros(len(fps), int), fps).components(4).tolist()) == {0}


def test_groups_equal_brute_force(spark):
    rnd = random.Random(5)
    fps = near_set(rnd, 400)
    rows = [(i, fp - 2**64 if fp >= 2**63 else fp) for i, fp in enumerate(fps)] + [(500, 0), (501, 0), (None, 0)]
    rnd.shuffle(rows)
    got = {(r.doc_id, r.component_id) for r in simhash.groups(spark.createDataFrame(rows, "doc_id long, fp long")).collect()}
    want = set(enumerate(brute(fps, 4)))
    assert got == want | {(500, dict(want)[0]), (501, dict(want)[0]), (None, dict(want)[0])}


def test_hot_buckets_are_dealt_anew(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAVES", 20)
    rnd = random.Random(6)
    bits = rnd.sample(range(64), 14)
    fps = sorted({sum(1 << b for b in rnd.sample(bits, rnd.randint(3, 11))) for _ in range(260)} | set(near_set(rnd, 150)))
    nodes = spark.createDataFrame([(fp - 2**64 if fp >= 2**63 else fp,) for fp in fps], "fp long")
    dealt = simhash.dealt(nodes).groupBy("bucket").count().collect()
    assert max(r["count"] for r in simhash.buckets(nodes).groupBy("bucket").count().collect()) > 60
    assert max(r["count"] for r in dealt) <= 20
    got = {(r.doc_id, r.component_id) for r in simhash.groups(nodes.selectExpr("fp", "row_number() OVER (ORDER BY fp < 0, fp) - 1L AS doc_id")).collect()}
    assert got == set(enumerate(brute(fps, 4)))


def test_fingerprints_and_edge_cases(spark):
    texts = ["", None, " \t\n", "One", "ONE two", "a b c d", "A b C d e É É", "x " * 70000, "nb sp ace d", "é" * 9]
    rows = [(i, t, "clash", i) for i, t in enumerate(texts)] + [(None, "a b c d", "", 0), (5, "a b c d", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert r.fp % 2**64 == plain_fingerprint(texts[r.doc_id])
    assert {r.component_id for r in got if r.doc_id in (0, 1, 2)} == {0}
    assert {r.component_id for r in got if r.doc_id in (5, None)} == {5}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    a, b, c, d = ("alpha beta gamma delta epsilon", "one two three four five six", "red green blue cyan pink", "some text that stands quite alone")
    rows = [(None, a, 0), (1, a, 1), (None, d, 2), (2, b, 3), (2, b, 4), (1, c, 5), (3, c, 6), (1, "only here with this id", 7), (None, "x y z u v", 8), (None, "x y z u v", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    got = [r.n for r in kept.collect()]
    assert {1, 2, 5, 7} <= set(got) and len({3, 4} & set(got)) == len({8, 9} & set(got)) == 1 and len(got) == 6
    assert simhash.keep_first(docs.limit(0)).count() == 0
