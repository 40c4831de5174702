"""Seeded generators of graphs, points and formulas. Each row depends on its index and the seed only,
so the result is the same for any partitioning and after any retry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.plans.graph import Graph


def uniform(seed: int, *key: Column | str) -> Column:
    """A double in [0, 1) from a hash of the key."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11) / F.lit(float(1 << 53))


def below(n: int | Column, seed: int, *key: Column | str) -> Column:
    return F.least(F.floor(uniform(seed, *key) * n), F.lit(n).cast("long") - 1) if isinstance(n, int) else F.least(F.floor(uniform(seed, *key) * n), n.cast("long") - 1)


def torus(spark: SparkSession, n: int) -> Graph:
    """n x n vertices with edges to the four neighbours, wrapping round."""
    ids = spark.range(n * n)
    x, y = F.col("id") % n, F.floor(F.col("id") / n)
    at = lambda a, b: F.pmod(b, F.lit(n)) * n + F.pmod(a, F.lit(n))
    return Graph(ids, ids.select(F.col("id").alias("src"), F.explode(F.array(at(x + 1, y), at(x - 1, y), at(x, y + 1), at(x, y - 1))).alias("dst")))


def random_graph(spark: SparkSession, n: int, density: int = 4, max_weight: int = 10_000, seed: int = 1) -> Graph:
    """Connected: a ring and density - 1 further edges a vertex, no doubles, no loops."""
    ids = spark.range(n)
    ring = ids.select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    more = ids.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(max(1, density - 1)))).alias("k")).select("src", below(n, seed, "src", "k").alias("dst"))
    own = ring.unionByName(more).filter("src <> dst").distinct()
    return Graph(ids, own.withColumn("w", 1 + below(max_weight, seed + 1, "src", "dst")))


def hilbert(x: Column, y: Column, order: int) -> Column:
    """Place of (x, y) on the Hilbert curve over 2 ** order squares a side."""
    d = F.lit(0).cast("long")
    for k in range(order - 1, -1, -1):
        rx, ry = F.shiftright(x, k).bitwiseAND(F.lit(1)), F.shiftright(y, k).bitwiseAND(F.lit(1))
        d = d * 4 + (3 * rx).bitwiseXOR(ry)
        top = (1 << k) - 1
        x, y = x.bitwiseAND(F.lit(top)), y.bitwiseAND(F.lit(top))
        turned, flip = ry == 0, rx == 1
        x, y = F.when(turned, F.when(flip, F.lit(top) - y).otherwise(y)).otherwise(x), F.when(turned, F.when(flip, F.lit(top) - x).otherwise(x)).otherwise(y)
    return d


def grid(spark: SparkSession, n: int, seed: int | None = None, curve: bool = False) -> Graph:
    """n x n grid, edges to the right and down both ways; vertices numbered by row, by the Hilbert
    curve (n a power of two), or by a seeded shuffle."""
    cells = spark.range(n * n).select((F.col("id") % n).alias("x"), F.floor(F.col("id") / n).alias("y"))
    order = max(1, (n - 1).bit_length())

    def number(x: Column, y: Column) -> Column:
        if curve:
            return hilbert(x, y, order)
        plain = y * n + x
        if seed is None:
            return plain
        odd = 2 * (seed * 7919 % max(1, n * n)) + 1
        while _gcd(odd, n * n) > 1:
            odd += 2
        return (plain * odd + seed) % (n * n)

    x, y = F.col("x"), F.col("y")
    right = cells.filter(x < n - 1).select(number(x, y).alias("src"), number(x + 1, y).alias("dst"))
    down = cells.filter(y < n - 1).select(number(x, y).alias("src"), number(x, y + 1).alias("dst"))
    return Graph(cells.select(number(x, y).alias("id")), right.unionByName(down), False).symmetrize()


def _gcd(a: int, b: int) -> int:
    while b:
        a, b = b, a % b
    return a


def points(spark: SparkSession, n: int, dimensions: int = 2, seed: int = 1, scale: float = 1.0) -> DataFrame:
    names = ["x", "y", "z"][:dimensions]
    return spark.range(n).select("id", *((uniform(seed + k, "id") * scale).alias(c) for k, c in enumerate(names)))


def bipartite(spark: SparkSession, left: int, right: int, density: int = 3, groups: int = 1, seed: int = 1) -> Graph:
    """Even ids left, odd ids right; a left vertex has edges into its own group on the right only."""
    ids = spark.range(left).select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(density))).alias("k"))
    width = max(1, right // groups)
    b = F.least((F.col("a") % groups) * width + below(width, seed, "a", "k"), F.lit(right - 1))
    own = ids.select((2 * F.col("a")).alias("src"), (2 * b + 1).alias("dst")).distinct()
    vertices = spark.range(left).select((2 * F.col("id")).alias("id")).unionByName(spark.range(right).select((2 * F.col("id") + 1).alias("id")))
    return Graph(vertices, own)


def ksat(spark: SparkSession, clauses: int, variables: int, k: int = 3, seed: int = 1) -> DataFrame:
    """(clause, var, positive): k literals a clause over distinct variables where there are enough."""
    rows = spark.range(clauses).select(F.col("id").alias("clause"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("place"))
    start, step = below(variables, seed, "clause"), 1 + below(max(1, (variables - 1) // max(1, k - 1)), seed + 1, "clause")
    return rows.select("clause", ((start + F.col("place") * step) % variables).alias("var"), (uniform(seed + 2, "clause", "place") < 0.5).alias("positive"))


def plummer(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """Bodies (id, mass, x, y, z, vx, vy, vz) of a Plummer model in equilibrium, total mass 1."""
    import math

    unit = 3 * math.pi / 16
    ids = spark.range(n)
    m = F.least(F.lit(0.999), F.greatest(F.lit(1e-9), uniform(seed, "id") * 0.999))
    r = 1 / F.sqrt(F.pow(m, F.lit(-2 / 3)) - 1)

    def direction(k: int, length: Column) -> list[Column]:
        z, angle = 2 * uniform(seed + k, "id") - 1, 2 * math.pi * uniform(seed + k + 1, "id")
        flat = F.sqrt(1 - z * z)
        return [length * flat * F.cos(angle), length * flat * F.sin(angle), length * z]

    # speed as a share of escape speed: the first of 16 tries that the density q^2 (1 - q^2)^3.5 accepts
    tries = F.array(*(F.struct(uniform(seed + 10 + 2 * k, "id").alias("q"), (uniform(seed + 11 + 2 * k, "id") * 0.1).alias("u")) for k in range(16)))
    held = F.filter(tries, lambda t: t["u"] < t["q"] * t["q"] * F.pow(1 - t["q"] * t["q"], F.lit(3.5)))
    q = F.coalesce(F.get(held, F.lit(0))["q"], F.lit(0.5))
    speed = q * F.sqrt(F.lit(2.0)) * F.pow(1 + r * r, F.lit(-0.25)) / math.sqrt(unit)
    place, move = direction(50, r * unit), direction(60, speed)
    return ids.select("id", F.lit(1.0 / max(1, n)).alias("mass"), *(c.alias(a) for a, c in zip(("x", "y", "z", "vx", "vy", "vz"), place + move, strict=True)))


def lights(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """Point lights (id, x, y, z, intensity, and a unit direction dx, dy, dz)."""
    z, angle = 2 * uniform(seed + 5, "id") - 1, 6.283185307179586 * uniform(seed + 6, "id")
    flat = F.sqrt(1 - z * z)
    return points(spark, n, 3, seed).select("*", uniform(seed + 4, "id").alias("intensity"), (flat * F.cos(angle)).alias("dx"), (flat * F.sin(angle)).alias("dy"), z.alias("dz"))
