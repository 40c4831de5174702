"""Survey propagation on a K-SAT factor graph, with decimation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.plans import engine
from weftgraph.plans.engine import in_one_task
from weftgraph.plans.scratch import discard, materialize
from weftgraph.sources.generators import ksat, uniform

TOLERANCE, ROUNDS, SHARE = 1e-6, 100, 0.05


def _product(factor: Column) -> list[Column]:
    """(zeros, log) sums of a product of factors in [0, 1], which are enough to leave one out."""
    return [F.count_if(factor <= 0), F.sum(F.when(factor > 0, F.log(factor)).otherwise(0.0))]


def surveys(clauses: DataFrame, tolerance: float = TOLERANCE, rounds: int = ROUNDS, seed: int = 1) -> DataFrame:
    """(clause, var, positive, eta): the chance that the clause warns the variable, at the fixpoint of
    eta(a, i) = product over the clause's other variables j of the chance that j must violate a."""
    state = materialize(clauses.withColumn("eta", uniform(seed, "clause", "var")), "surveys")
    if state.count() <= engine.COMPACT_EDGES:
        return materialize(_surveys_compact(state, tolerance, rounds), "surveys")
    for _ in range(rounds):
        keep = 1 - F.col("eta")
        each = state.groupBy("var", "positive").agg(*(p.alias(n) for n, p in zip(("z", "l"), _product(keep), strict=True)))
        same = each.toDF("var", "positive", "zs", "ls")
        other = each.select("var", (~F.col("positive")).alias("positive"), F.col("z").alias("zo"), F.col("l").alias("lo"))
        met = state.join(same, ["var", "positive"]).join(other, ["var", "positive"], "left").fillna(0, ["zo", "lo"])
        # without the clause's own factor
        own_zero = (keep <= 0).cast("int")
        s = F.when(F.col("zs") - own_zero > 0, 0.0).otherwise(F.exp(F.col("ls") - F.when(keep > 0, F.log(keep)).otherwise(0.0)))
        o = F.when(F.col("zo") > 0, 0.0).otherwise(F.exp("lo"))
        must, must_not, free = (1 - o) * s, (1 - s) * o, s * o
        total = must + must_not + free
        chance = F.when(total > 0, must / total).otherwise(0.0)
        sent = met.select("clause", "var", "positive", "eta", chance.alias("c"))
        in_clause = sent.groupBy("clause").agg(*(p.alias(n) for n, p in zip(("zc", "lc"), _product(F.col("c")), strict=True)))
        joined = sent.join(in_clause, "clause")
        zero = (F.col("c") <= 0).cast("int")
        eta = F.when(F.col("zc") - zero > 0, 0.0).otherwise(F.exp(F.col("lc") - F.when(F.col("c") > 0, F.log("c")).otherwise(0.0)))
        new = materialize(joined.select("clause", "var", "positive", F.least(eta, F.lit(1.0)).alias("eta"), F.abs(eta - F.col("eta")).alias("change")), "surveys")
        discard(state)
        state = new
        if (new.agg(F.max("change")).first()[0] or 0) <= tolerance:
            break
    return state.select("clause", "var", "positive", "eta")


def _others(factor: np.ndarray, group: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(zeros, log) sums of each group's product, and the product without one's own factor."""
    zero, log = factor <= 0, np.log(np.where(factor > 0, factor, 1.0))
    zeros, logs = np.bincount(group, zero, size), np.bincount(group, log, size)
    return zeros, logs, np.where(zeros[group] - zero > 0, 0.0, np.exp(logs[group] - log))


def _settled(clause: np.ndarray, side: np.ndarray, eta: np.ndarray, tolerance: float, rounds: int) -> np.ndarray:
    """surveys over arrays; a side is twice the variable's number, and one for a positive literal."""
    variables, clauses = int(side.max(initial=-2) // 2 + 1), int(clause.max(initial=-1) + 1)
    for _ in range(rounds if len(clause) else 0):
        zeros, logs, s = _others(1 - eta, side, 2 * variables)
        o = np.where(zeros[side ^ 1] > 0, 0.0, np.exp(logs[side ^ 1]))
        must, total = (1 - o) * s, (1 - o) * s + (1 - s) * o + s * o
        new = np.minimum(_others(np.where(total > 0, must / np.where(total > 0, total, 1), 0.0), clause, clauses)[2], 1.0)
        change, eta = np.abs(new - eta).max(), new
        if change <= tolerance:
            break
    return eta


def _surveys_compact(state: DataFrame, tolerance: float, rounds: int) -> DataFrame:
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        clause, var = (np.unique(pdf[c], return_inverse=True)[1] for c in ("clause", "var"))
        eta = _settled(clause, 2 * var + pdf["positive"].to_numpy(bool), pdf["eta"].to_numpy(float), tolerance, rounds)
        return pdf.assign(eta=eta)

    return in_one_task(state.select("clause", "var", "positive", "eta"), kernel, "clause long, var long, positive boolean, eta double")


def _assignment_compact(own: DataFrame, share: float) -> DataFrame:
    """(var, value) by the rounds of ``solve`` over arrays."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["clause", "var", "positive"], ignore_index=True)
        names, var = np.unique(pdf["var"], return_inverse=True)
        clause, sign, eta = np.unique(pdf["clause"], return_inverse=True)[1], pdf["positive"].to_numpy(bool), pdf["eta"].to_numpy(float)
        value, open_ = np.full(len(names), -1), np.ones(len(pdf), bool)
        while open_.any():
            at = np.flatnonzero(open_)
            alone = at[np.bincount(clause[at])[clause[at]] == 1]
            if len(alone):
                np.maximum.at(value, var[alone], sign[alone])
            else:
                local, v = np.unique(var[at], return_inverse=True)
                side = 2 * v + sign[at]
                found = _settled(np.unique(clause[at], return_inverse=True)[1], side, eta[at], TOLERANCE, ROUNDS)
                kept = np.exp(np.bincount(side, np.log(np.maximum(1 - found, 1e-12)), 2 * len(local)))
                m, p = kept[::2], kept[1::2]
                plus, minus = (1 - p) * m, (1 - m) * p
                total = np.maximum(plus + minus + p * m, 1e-300)
                pull = (plus - minus) / total
                often = 2 * np.bincount(v, sign[at], len(local)) >= np.bincount(v, minlength=len(local))
                chosen = np.lexsort((local, -np.abs(pull)))[: max(1, int(share * len(local)))]
                rank = np.full(len(local), len(local))
                rank[chosen] = np.arange(len(chosen))
                best = np.full(clause.max() + 1, len(local))
                np.minimum.at(best, clause[at], rank[v])
                beaten = np.zeros(len(local), bool)
                beaten[v[best[clause[at]] < rank[v]]] = True
                chosen = chosen[~beaten[chosen]]
                value[local[chosen]] = np.where(np.abs(pull) < 1e-6, often, pull > 0)[chosen]
            fixed = value[var] >= 0
            done = np.zeros(clause.max() + 1, bool)
            done[clause[open_ & (value[var] == sign)]] = True
            open_ &= ~fixed & ~done[clause]
        met = np.flatnonzero(value >= 0)
        return pd.DataFrame({"var": names[met], "value": value[met].astype(bool)})

    return in_one_task(own.withColumn("eta", uniform(1, "clause", "var")), kernel, "var long, value boolean")


def bias(found: DataFrame) -> DataFrame:
    """(var, plus, minus): the chances that a variable must be true and false."""
    one = lambda sign: F.exp(F.sum(F.when(F.col("positive") == sign, F.log(F.greatest(1 - F.col("eta"), F.lit(1e-12)))).otherwise(0.0)))
    p = found.groupBy("var").agg(one(F.lit(True)).alias("p"), one(F.lit(False)).alias("m"))
    plus, minus, free = (1 - F.col("p")) * F.col("m"), (1 - F.col("m")) * F.col("p"), F.col("p") * F.col("m")
    total = F.greatest(plus + minus + free, F.lit(1e-300))
    return p.select("var", (plus / total).alias("plus"), (minus / total).alias("minus"))


def solve(clauses: DataFrame, share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """((var, value), the clauses left unsatisfied): decimation by bias. Each round fixes a share of
    the variables, those of greatest bias, but of those in one clause only the first; satisfied clauses and false literals go; a variable alone
    in a clause takes the clause's sign first."""
    own = materialize(clauses.select("clause", "var", "positive").distinct(), "formula")
    rest, fixed = own, None
    if own.count() <= engine.COMPACT_EDGES:
        rest, fixed = own.limit(0), _assignment_compact(own, share)
    while not rest.isEmpty():
        units = rest.groupBy("clause").agg(F.count("*").alias("n"), F.min("var").alias("var"), F.min_by("positive", "var").alias("value")).filter("n = 1")
        units = units.groupBy("var").agg(F.max("value").alias("value"))
        chosen = materialize(units, "fixed")
        if chosen.isEmpty():
            pull = materialize(bias(surveys(rest)), "bias")
            n = max(1, int(share * pull.count()))
            votes = rest.groupBy("var").agg((2 * F.count_if("positive") >= F.count("*")).alias("often"))
            flat = F.abs(F.col("plus") - F.col("minus")) < 1e-6
            value = F.when(flat, F.col("often")).otherwise(F.col("plus") > F.col("minus"))
            ranked = pull.join(votes, "var").select("var", value.alias("value"), F.struct((-F.abs(F.col("plus") - F.col("minus"))).alias("b"), "var").alias("rank"))
            ranked = materialize(ranked.orderBy("rank").limit(n), "ranked")
            near = rest.select("clause", "var").join(ranked, "var")
            best = near.groupBy("clause").agg(F.min("rank").alias("best"))
            beaten = near.join(best, "clause").filter("best < rank").select("var")
            chosen = materialize(ranked.join(beaten, "var", "left_anti").select("var", "value"), "fixed")
        fixed = chosen if fixed is None else fixed.unionByName(chosen)
        met = rest.join(chosen, "var", "left")
        done = met.filter("value = positive").select("clause").distinct()
        rest = materialize(met.filter("value IS NULL").join(done, "clause", "left_anti").select("clause", "var", "positive"), "formula")
    if fixed is None:
        fixed = own.limit(0).select("var", F.col("positive").alias("value"))
    fixed = materialize(fixed, "assignment")
    good = own.join(fixed, "var").filter("value = positive").select("clause")
    return fixed, own.select("clause").distinct().join(good, "clause", "left_anti")


def _q_sat(spark, sf_dir):
    """How many clauses the assignment leaves unsatisfied, and whether it gives a variable one value."""
    formula = materialize(ksat(spark, 2000, 1000), "formula")
    found, bad = solve(formula, SHARE)
    return bad.agg(F.count("*").alias("unsatisfied")).crossJoin(found.agg((F.count("*") == F.count_distinct("var")).alias("one_value")))


QUERIES = {"sat_sp": _q_sat}
ORACLES = {"sat_sp": "SELECT CAST(0 AS BIGINT) AS unsatisfied, true AS one_value"}
