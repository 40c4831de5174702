"""Linear regression: batch and stochastic gradient descent, coordinate descent with an L1 penalty."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.reduce import feature_scale
from weftgraph.plans.scratch import materialize

ROUNDS, PENALTY = 200, 0.001


def moments(samples: DataFrame, features: list[str], target: str) -> tuple[np.ndarray, np.ndarray, float, int]:
    """X'X / n, X'y / n, y'y / n and n, an intercept first: one aggregation of (d + 1)(d + 2) / 2
    sums is all that a gradient over all samples needs, in any number of rounds."""
    names = [F.lit(1.0), *(F.col(c).cast("double") for c in features)]
    y = F.col(target).cast("double")
    held = samples.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in [*features, target]))
    sums = [F.avg(names[i] * names[j]) for i in range(len(names)) for j in range(i, len(names))]
    row = held.agg(*sums, *(F.avg(n * y) for n in names), F.avg(y * y), F.count("*")).first()
    d, k = len(names), 0
    xx = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            xx[i, j] = xx[j, i] = row[k] or 0.0
            k += 1
    return xx, np.array([row[k + i] or 0.0 for i in range(d)]), row[k + d] or 0.0, row[k + d + 1]


def gradient_descent(samples: DataFrame, features: list[str], target: str, rounds: int = ROUNDS) -> np.ndarray:
    """Weights, the intercept first. The step grows while the loss falls and is halved when it rises."""
    xx, xy, yy, n = moments(samples, features, target)
    w, step = np.zeros(len(xy)), 0.5
    loss = lambda v: v @ xx @ v - 2 * v @ xy + yy
    for _ in range(rounds if n else 0):
        new = w - step * (xx @ w - xy)
        while loss(new) > loss(w) and step > 1e-12:
            step /= 2
            new = w - step * (xx @ w - xy)
        w, step = new, step * 1.1
    return w


def coordinate_descent(samples: DataFrame, features: list[str], target: str, penalty: float = PENALTY, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of least squares with an L1 penalty on all but the intercept; coordinates in turn."""
    xx, xy, _, n = moments(samples, features, target)
    w = np.zeros(len(xy))
    for _ in range(rounds if n else 0):
        for k in range(len(w)):
            rest = xy[k] - xx[k] @ w + xx[k, k] * w[k]
            low = 0.0 if not k else penalty
            w[k] = np.sign(rest) * max(abs(rest) - low, 0) / xx[k, k] if xx[k, k] else 0.0
    return w


def stochastic_descent(samples: DataFrame, features: list[str], target: str, rounds: int = 20, rate: float = 0.05) -> np.ndarray:
    """Weights averaged over the partitions by their samples: each goes through its own samples in
    batches, from the same start, in each round."""
    own = materialize(samples.select(*(F.col(c).cast("double").alias(c) for c in [*features, target])).dropna(), "samples")
    names = [f"w{k}" for k in range(len(features) + 1)]
    w = np.zeros(len(names))
    for turn in range(rounds):
        start, step = w.copy(), rate / (1 + turn / 4)

        def run(stream, start=start, step=step):
            v, n = start.copy(), 0
            for pdf in stream:
                x, y = np.column_stack([np.ones(len(pdf)), pdf[features].to_numpy()]), pdf[target].to_numpy()
                for at in range(0, len(x), 64):
                    a, b = x[at : at + 64], y[at : at + 64]
                    v -= step * a.T @ (a @ v - b) / len(b)
                n += len(x)
            if n:
                yield pd.DataFrame([[n, *v]], columns=["n", *names])

        rows = own.mapInPandas(run, "n long, " + ", ".join(f"{c} double" for c in names))
        got = rows.agg(*(F.sum(F.col(c) * F.col("n")) / F.sum("n") for c in names)).first()
        if got[0] is None:
            return w
        w = np.array(list(got))
    return w


def loss(samples: DataFrame, features: list[str], target: str, w: np.ndarray) -> float:
    guess = F.lit(float(w[0]))
    for c, v in zip(features, w[1:], strict=True):
        guess = guess + F.col(c) * float(v)
    return samples.agg(F.avg((F.col(target) - guess) * (F.col(target) - guess))).first()[0]


FEATURES, TARGET = ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*FEATURES, (F.col(TARGET) / 1000).alias(TARGET))
    return feature_scale(own, *FEATURES)


def _q_gd(spark, sf_dir):
    own = _samples(spark, sf_dir)
    w = gradient_descent(own, ["l_quantity"], TARGET, 5000)
    return spark.createDataFrame([(round(float(w[0]), 5), round(float(w[1]), 5))], "intercept double, slope double")


def _near_best(fit, slack: float):
    """Whether the loss is within ``slack`` of the best there is, over all three features."""

    def query(spark, sf_dir):
        own = materialize(_samples(spark, sf_dir), "samples")
        xx, xy, yy, n = moments(own, FEATURES, TARGET)
        best = np.linalg.solve(xx, xy)
        ok = loss(own, FEATURES, TARGET, fit(own)) <= loss(own, FEATURES, TARGET, best) * (1 + slack)
        return spark.createDataFrame([(n, bool(ok))], "samples long, near_best boolean")

    return query


QUERIES = {
    "lr_gd": _q_gd,
    "lr_sgd": _near_best(lambda own: stochastic_descent(own, FEATURES, TARGET), 0.02),
    "lr_scd": _near_best(lambda own: coordinate_descent(own, FEATURES, TARGET), 0.001),
}
_NEAR = "SELECT count(*) AS samples, true AS near_best FROM lineitem"
ORACLES = {
    "lr_gd": """WITH s AS (SELECT l_extendedprice / 1000 AS y, (l_quantity - avg(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()) AS x FROM lineitem)
SELECT round(regr_intercept(y, x), 5) AS intercept, round(regr_slope(y, x), 5) AS slope FROM s""",
    "lr_sgd": _NEAR,
    "lr_scd": _NEAR,
}
