import random
import re
from collections import Counter

import duckdb

from weftgraph.llm import decontaminate as dc


def ws(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def bag(words):
    return Counter(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def brute(docs, items):
    best = {}
    for d, t in docs:
        w = ws(t)
        for i, it in items:
            iw = ws(it)
            if not iw or not w:
                continue
            b = bag(iw)
            for s in range(max(1, len(w) - len(iw) + 1)):
                a = bag(w[s : s + len(iw)])
                sim = sum((a & b).values()) / sum((a | b).values())
                if sim >= 0.8 and (d, i) not in best or sim >= 0.8 and sim > best[d, i][0]:
                    best[d, i] = (sim, s)
    return best


def test_equals_brute_force(spark):
    rnd = random.Random(7)
    vocab = [f"w{k}" for k in range(300)] + ["É", "das", "x1"]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(k, text(rnd.randint(12, 60))) for k in range(25)] + [(90, "One two"), (91, ""), (92, None), (93, "a a a a a a a a a a")]
    docs = []
    for d in range(120):
        it = rnd.choice(items[:25])[1].split()
        if d % 3 == 1 and len(it) > 30:  # an edit at an end leaves a similarity over 0.8
            it[-1] = "changed"
        if d % 3 == 2 and len(it) > 50:
            it[rnd.randrange(len(it))] = "changed"
        sep = rnd.choice([" ", ", ", "\n"])
        docs.append((d, text(rnd.randint(0, 80)) + ". " + sep.join(it).upper() + "! " + text(rnd.randint(0, 40))))
    docs += [(200, None), (201, ""), (202, "one, TWO"), (203, "b " + "a " * 12), (204, items[0][1]), (205, " ".join(items[0][1].split()[:-1])), (None, items[1][1]), (206, "x " * 30_000 + items[2][1])]
    frame = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, words string")
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, n int")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in dc.matches(frame, bench).collect()}
    want = brute(docs, items)
    assert {k: round(v[0], 9) for k, v in got.items()} == {k: round(v[0], 9) for k, v in want.items()}
    texts, own = dict(docs), dict(items)
    for (d, i), (sim, at) in got.items():  # the window told has that similarity
        a, b = ws(texts[d]), ws(own[i])
        a, b = bag(a[at : at + len(b)]), bag(b)
        assert abs(sum((a & b).values()) / sum((a | b).values()) - sim) < 1e-9
    clean = dc.decontaminate(frame, bench)
    assert clean.columns == frame.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_blocks_find_all_within_the_radius(spark):
    rnd = random.Random(1)
    rows = []
    for k in range(300):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), rnd.randint(0, dc.RADIUS)):
            b ^= 1 << bit
        rows.append((k, *(x - 2**64 if x >= 2**63 else x for x in (a, b))))
    df = spark.createDataFrame(rows, "k int, a long, b long")
    from pyspark.sql import functions as F

    found = dc.candidates(df.select("k", F.lit(9).alias("n"), F.col("k").cast("string").alias("text"), F.col("b").alias("fp")), df.select(F.col("k").alias("item_id"), F.lit(9).alias("n"), F.col("a").alias("item_fp")))
    assert {(r.text, r.item_id) for r in found.collect()} >= {(str(k), k) for k in range(300)}


def test_recall_at_the_threshold(spark):
    """Windows with a similarity just over 0.8: an item of 100 words and its copy with one or two words
    changed at a place where 5 or 10 of 96 shingles go."""
    rnd = random.Random(3)
    items, docs = [], []
    for k in range(400):
        w = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice((60, 100)))]
        items.append((k, " ".join(w)))
        for at in rnd.sample(range(len(w)), 2 if len(w) == 100 else 1):
            w[at] = "changed"
        docs.append((k, " ".join(w)))
    want = {(d, i) for (d, i), _ in brute_own(docs, items).items()}
    got = {(r.doc_id, r.item_id) for r in dc.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want and len(want) > 300 and len(got) >= 0.99 * len(want)


def brute_own(docs, items):
    """brute, where a document can only hold the item with its own number."""
    return {k: v for d, i in zip(docs, items, strict=True) for k, v in brute([d], [i]).items()}


def test_items_of_different_length_within_one_another(spark):
    words = [f"n{k}" for k in range(52)]
    items = [(10, " ".join(words[:50])), (11, " ".join(words)), (12, "tiny item"), (13, "One")]
    docs = [(1, "before it " + items[0][1] + " and after " + "x " * 60), (2, "tiny ITEM, one"), (3, items[0][1]), (4, " ".join(words[:45]))]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start, r.n_words) for r in dc.matches(frame, bench).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: round(v[0], 9) for k, v in brute(docs, items).items()}
    assert got[1, 11][0] < 0.95 < got[3, 11][0]
    con = duckdb.connect()
    con.register("documents", frame.toPandas())
    con.register("benchmark", bench.toPandas())
    assert {(d, i): (round(s, 9), at, n) for d, i, s, at, n in con.execute(dc.ORACLE).fetchall()} == got


def test_benchmark_in_blocks_and_empty(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK", 7)
    items = [(k, f"i{k} a b c d e f g{k}") for k in range(9)]
    docs = [(k, f"x {t} y") for k, t in items]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.matches(frame, bench).collect()} >= {(k, k) for k in range(9)}
    assert dc.matches(frame, bench.limit(0)).count() == 0
    assert dc.matches(frame.limit(0), bench).count() == 0


def test_only_the_rows_with_an_item_go(spark):
    item = "what is the name of the river that flows through the old town"
    rows = [(None, f"x {item} y", 0), (None, "clean without an id", 1), (4, item, 2), (4, "clean with a repeated id", 3), (5, "clean", 4), (5, "clean", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    clean = dc.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert clean.columns == docs.columns and sorted(r.n for r in clean.collect()) == [1, 3, 4, 5]
