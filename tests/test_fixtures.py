import random

from weftgraph.operators.components import dense_ids
from weftgraph.plans.fixtures import next_in_order
from weftgraph.sources.text import numbered_lines, write_lines


def test_next_in_order_and_dense_ids(spark):
    rnd = random.Random(4)
    rows = [(t, rnd.randrange(9)) for t in rnd.sample(range(10_000), 300)]
    df = spark.createDataFrame(rows, "t long, v long").repartition(7)
    got = {r.t: r.next for r in next_in_order(df, "v", "t").collect()}
    rows.sort()
    assert got == {a[0]: b[1] for a, b in zip(rows, rows[1:], strict=False)} | {rows[-1][0]: None}
    places = {r.t: r.place for r in dense_ids(df, "t").collect()}
    assert places == {t: k for k, (t, _) in enumerate(rows)}
    assert next_in_order(df.limit(0), "v", "t").count() == 0


def test_numbered_lines_hold_over_files(spark, tmp_path):
    df = spark.range(1000).repartition(9).selectExpr("id", "concat('line ', id) AS value")
    write_lines(df, f"{tmp_path}/t", "id", header=["first", "second"])
    got = {r.line: r.value for r in numbered_lines(spark, f"{tmp_path}/t").collect()}
    assert got == {0: "first", 1: "second"} | {k + 2: f"line {k}" for k in range(1000)}
