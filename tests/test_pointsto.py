"""Points-to analysis against a plain fixpoint, and that alike variables' facts are kept once."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import pointsto


def plain(rows):
    points = {}
    while True:
        before = sum(map(len, points.values()))
        for s, d, kind in rows:
            of = lambda v: list(points.get(v, ()))
            gives = [(s, [d])] if kind == 0 else [(s, of(d))] if kind == 1 else [(s, of(m)) for m in of(d)] if kind == 2 else [(m, of(d)) for m in of(s)]
            for to, objects in gives:
                points.setdefault(to, set()).update(objects)
        if sum(map(len, points.values())) == before:
            return {(v, o) for v, some in points.items() for o in some}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_constraints(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(12), rnd.randrange(12), rnd.choice([0, 0, 1, 1, 2, 3])) for _ in range(22)]
    own, want = spark.createDataFrame(rows, "src long, dst long, type int"), plain(rows)
    got = pointsto.points_to(own)
    pairs = [tuple(r) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    classes, points = pointsto.points_to_classes(own)
    assert pointsto.unsatisfied(own, points, classes).first()[0] == 0
    assert pointsto.unsatisfied(own, got).first()[0] == 0
    less = got.filter(F.col("object") != min(o for _, o in want))
    assert pointsto.unsatisfied(own, less).first()[0] > 0


def test_alike_variables_share_their_facts(spark):
    """1 holds 200 objects; through 0, 2 = *.. stores all into each of them: 40,000 facts."""
    rows = [(1, 100 + k, 0) for k in range(200)] + [(1, 1, 3)]
    classes, points = pointsto.points_to_classes(spark.createDataFrame(rows, "src long, dst long, type int"))
    assert points.count() <= 400
    assert classes.join(points, "cls").count() == 201 * 200
