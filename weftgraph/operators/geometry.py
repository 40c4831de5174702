"""Plane geometry and meshes: predicates as columns, adjacency and neighbours as joins, incremental
triangulation and refinement as a bounded kernel with certificates."""

from __future__ import annotations

import bisect
import itertools
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.engine import in_one_task
from weftgraph.plans.scratch import materialize

MIN_ANGLE = 30.0
#: Points that one triangulation may have: it is a sequential structure in one task.
MOST_POINTS = 200_000


def orientation(ax, ay, bx, by, cx, cy) -> Column:
    """Twice the signed area: positive if a, b, c turn left."""
    return (bx - ax) * (cy - ay) - (cx - ax) * (by - ay)


def in_circle(ax, ay, bx, by, cx, cy, px, py) -> Column:
    """Positive if p is inside the circle through a, b, c, given that they turn left."""
    adx, ady, bdx, bdy, cdx, cdy = ax - px, ay - py, bx - px, by - py, cx - px, cy - py
    a, b, c = adx * adx + ady * ady, bdx * bdx + bdy * bdy, cdx * cdx + cdy * cdy
    return a * (bdx * cdy - cdx * bdy) - b * (adx * cdy - cdx * ady) + c * (adx * bdy - bdx * ady)


def cosines(ax, ay, bx, by, cx, cy) -> list[Column]:
    """Cosine of the angle at each corner."""

    def at(px, py, qx, qy, rx, ry):
        dot = (qx - px) * (rx - px) + (qy - py) * (ry - py)
        return dot / F.nullif(F.sqrt(((qx - px) * (qx - px) + (qy - py) * (qy - py)) * ((rx - px) * (rx - px) + (ry - py) * (ry - py))), F.lit(0.0))

    return [at(ax, ay, bx, by, cx, cy), at(bx, by, ax, ay, cx, cy), at(cx, cy, ax, ay, bx, by)]


def is_bad(*corners, min_angle: float = MIN_ANGLE) -> Column:
    """Whether an angle is below the least wanted one."""
    return F.greatest(*cosines(*corners)) > math.cos(math.radians(min_angle))


def is_obtuse(*corners) -> Column:
    return F.least(*cosines(*corners)) < 0


def with_corners(ele: DataFrame, node: DataFrame) -> DataFrame:
    """Triangles with x1, y1 .. x3, y3."""
    out = ele
    for k in (1, 2, 3):
        out = out.join(node.select(F.col("id").alias(f"p{k}"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")), f"p{k}")
    return out


CORNERS = ["x1", "y1", "x2", "y2", "x3", "y3"]


def corners() -> list[Column]:
    return [F.col(c) for c in CORNERS]


def mesh_adjacency(ele: DataFrame) -> DataFrame:
    """(a, b): triangles a < b with an edge in common."""
    sides = F.array(*(F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v")) for p, q in (("p1", "p2"), ("p2", "p3"), ("p3", "p1"))))
    edges = ele.select("id", F.explode(sides).alias("e")).select("id", "e.u", "e.v")
    pairs = edges.groupBy("u", "v").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n"))
    many = pairs.filter("n > 2")  # not a surface there: all pairs of the few triangles
    crowded = edges.join(many.select("u", "v"), ["u", "v"], "left_semi")
    more = crowded.toDF("u", "v", "a").join(crowded.toDF("u", "v", "b"), ["u", "v"]).filter("a < b").select("a", "b")
    return pairs.filter("n = 2").select("a", "b").union(more).distinct()


def refine_stats(ele: DataFrame, node: DataFrame) -> DataFrame:
    full = with_corners(ele, node)
    return full.agg(F.count("*").alias("elements"), F.count_if(is_bad(*corners())).alias("bad"))


def nearest(points: DataFrame, exact: bool = True) -> DataFrame:
    """(id, near, d2): the nearest other point, ties to the smallest id, and its squared distance.

    Points with equal places find each other at once. The rest look in the 3 x 3 cells around them,
    from cells of about one point up; a neighbour no farther than the cell's side is the nearest,
    and only points without one go on to cells twice as wide. Without ``exact`` the first neighbour
    found stays, which is at most about 2.9 times as far as the nearest."""
    own = materialize(points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "points")
    same = own.groupBy("x", "y").agg(F.min("id").alias("a"), F.count("*").alias("n"), F.min(F.struct("id")).alias("s"))
    second = own.join(same.filter("n > 1").select("x", "y", "a"), ["x", "y"]).filter("id <> a").groupBy("x", "y", "a").agg(F.min("id").alias("b"))
    doubled = own.join(second, ["x", "y"]).select("id", F.when(F.col("id") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("near"), F.lit(0.0).alias("d2"))
    done = [materialize(doubled, "near")]
    places = materialize(same.select(F.col("a").alias("id"), "x", "y"), "places")
    open_ = materialize(places.join(done[0].select("id"), "id", "left_anti").select("id", "x", "y"), "open")
    box = places.agg(F.min("x").alias("x"), F.min("y").alias("y"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("side"), F.count("*").alias("n")).first()
    if not box["n"] or box["n"] < 2:
        return done[0]
    side = (box["side"] or 1.0) / max(1.0, math.sqrt(box["n"]))
    while not open_.isEmpty():
        cell = lambda c, low, s=side: F.floor((F.col(c) - low) / s)
        near = F.explode(F.expr("array(-1, 0, 1)"))
        looks = open_.select("id", "x", "y", cell("x", box["x"]).alias("i"), cell("y", box["y"]).alias("j")).select("*", near.alias("di")).select("*", near.alias("dj"))
        looks = looks.select("id", "x", "y", (F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"))
        filed = places.select(F.col("id").alias("o"), F.col("x").alias("ox"), F.col("y").alias("oy"), cell("x", box["x"]).alias("i"), cell("y", box["y"]).alias("j"))
        d2 = (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy"))
        best = looks.join(filed, ["i", "j"]).filter("id <> o").groupBy("id").agg(F.min(F.struct(d2.alias("d2"), F.col("o").alias("near"))).alias("b"))
        found = materialize(best.select("id", "b.near", "b.d2").filter((F.col("d2") <= side * side) if exact else F.lit(True)), "near")
        done.append(found)
        open_ = materialize(open_.join(found.select("id"), "id", "left_anti"), "open")
        side *= 2
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def kd_leaves(points: DataFrame, most: int = 32) -> DataFrame:
    """(id, leaf): nodes with more than ``most`` points are halved at the middle of their longer
    side's values; the leaf's number has a bit a level, after a leading one."""
    state = materialize(points.select("id", "x", "y", F.lit(1).cast("long").alias("leaf")), "kd")
    while True:
        stats = state.groupBy("leaf").agg(F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"), F.percentile("x", 0.5).alias("mx"), F.percentile("y", 0.5).alias("my"))
        split = materialize(stats.filter((F.col("n") > most) & (F.greatest("w", "h") > 0)), "kd-split")
        if split.isEmpty():
            return state.select("id", "leaf")
        high = F.when(F.col("w") >= F.col("h"), F.col("x") > F.col("mx")).otherwise(F.col("y") > F.col("my"))
        met = state.join(split.drop("n"), "leaf", "left")
        state = materialize(met.select("id", "x", "y", F.when(F.col("w").isNull(), F.col("leaf")).otherwise(2 * F.col("leaf") + F.coalesce(high, F.lit(False)).cast("long")).alias("leaf")), "kd")


class Triangulation:
    """Incremental Delaunay triangulation: a new point's cavity - the triangles whose circle holds
    it - is replaced by a fan. Points 0, 1, 2 are a triangle around all others."""

    def __init__(self, low: tuple[float, float], high: tuple[float, float]):
        cx, cy = (low[0] + high[0]) / 2, (low[1] + high[1]) / 2
        r = max(high[0] - low[0], high[1] - low[1], 1e-9)
        self.points = [(cx - 60 * r, cy - 40 * r), (cx + 60 * r, cy - 40 * r), (cx, cy + 80 * r)]
        self.triangles = {0: (0, 1, 2)}
        self.beside: dict[tuple[int, int], int] = {(0, 1): 0, (1, 2): 0, (2, 0): 0}  # by directed edge
        self.fresh, self.last = 1, 0

    def turn(self, a, b, c) -> float:
        (ax, ay), (bx, by), (cx, cy) = a, b, c
        return (bx - ax) * (cy - ay) - (cx - ax) * (by - ay)

    def holds(self, t: int, p) -> bool:
        (ax, ay), (bx, by), (cx, cy) = (self.points[i] for i in self.triangles[t])
        ax, ay, bx, by, cx, cy = ax - p[0], ay - p[1], bx - p[0], by - p[1], cx - p[0], cy - p[1]
        a, b, c = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        return a * (bx * cy - cx * by) - b * (ax * cy - cx * ay) + c * (ax * by - bx * ay) > 0

    def find(self, p) -> int:
        t = self.last if self.last in self.triangles else next(iter(self.triangles))
        for _ in range(4 * len(self.triangles) + 8):
            a, b, c = self.triangles[t]
            for u, v in ((a, b), (b, c), (c, a)):
                if self.turn(self.points[u], self.points[v], p) < 0 and (v, u) in self.beside:
                    t = self.beside[v, u]
                    break
            else:
                return t
        return next(t for t in self.triangles if self.holds(t, p))

    def add(self, p) -> int | None:
        """Number of the point, or None if it is one of the corners it falls on."""
        start = self.find(p)
        if any(self.points[i] == p for i in self.triangles[start]):
            return None
        cavity, stack = {start}, [start]
        while stack:
            a, b, c = self.triangles[stack.pop()]
            for u, v in ((a, b), (b, c), (c, a)):
                t = self.beside.get((v, u))
                if t is not None and t not in cavity and self.holds(t, p):
                    cavity.add(t)
                    stack.append(t)
        rim = [(u, v) for t in cavity for u, v in self._sides(t) if self.beside.get((v, u)) not in cavity]
        number = len(self.points)
        self.points.append(p)
        for t in cavity:
            for e in self._sides(t):
                del self.beside[e]
            del self.triangles[t]
        for u, v in rim:
            t, self.fresh = self.fresh, self.fresh + 1
            self.triangles[t] = (u, v, number)
            self.beside[u, v] = self.beside[v, number] = self.beside[number, u] = t
            self.last = t
        return number

    def _sides(self, t: int):
        a, b, c = self.triangles[t]
        return (a, b), (b, c), (c, a)


def _in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    """Points along a coarse curve, so that each is near its forerunner."""
    low, span = pdf[["x", "y"]].min(), (pdf[["x", "y"]].max() - pdf[["x", "y"]].min()).replace(0, 1)
    cells = max(1, int(math.sqrt(len(pdf)) / 2))
    row = ((pdf["y"] - low["y"]) / span["y"] * cells).astype(int)
    along = pdf["x"].where(row % 2 == 0, -pdf["x"])
    return pdf.assign(_r=row, _a=along).sort_values(["_r", "_a", "y", "id"])


def _bounded(points: DataFrame) -> DataFrame:
    own = materialize(points.select("id", "x", "y"), "points")
    if own.count() > MOST_POINTS:
        raise ValueError(f"a triangulation takes at most {MOST_POINTS} points")
    return own


def delaunay(points: DataFrame) -> DataFrame:
    """(id, p1, p2, p3) by the points' ids, counter-clockwise; of points at one place the one first
    in order is a corner."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 3:
            return pd.DataFrame({"id": [], "p1": [], "p2": [], "p3": []})
        pdf = _in_order(pdf.astype({"x": float, "y": float}))
        mesh = Triangulation((pdf["x"].min(), pdf["y"].min()), (pdf["x"].max(), pdf["y"].max()))
        ids = [None] * 3
        for i, x, y in pdf[["id", "x", "y"]].itertuples(index=False):
            if mesh.add((x, y)) is not None:
                ids.append(i)
        rows = sorted(tuple(ids[k] for k in t) for t in mesh.triangles.values() if min(t) > 2)
        return pd.DataFrame([(k, *r) for k, r in enumerate(rows)], columns=["id", "p1", "p2", "p3"])

    return in_one_task(_bounded(points), kernel, "id long, p1 long, p2 long, p3 long")


class Border:
    """The sides of a box, parted by the mesh's points on them. No point may lie within the circle over
    a part: a part that a point would come so near to is halved instead."""

    def __init__(self, mesh: Triangulation, low: tuple[float, float], high: tuple[float, float]):
        self.mesh = mesh
        points = mesh.points[3:]
        self.sides = [(axis, fixed, sign, sorted({p[axis] for p in points if p[1 - axis] == fixed})) for axis in (0, 1) for fixed, sign in ((low[1 - axis], 1), (high[1 - axis], -1))]
        for side in self.sides:
            axis, fixed, _, parts = side
            near = sorted((abs(p[1 - axis] - fixed), p[axis]) for p in points if p[1 - axis] != fixed)
            k = 0
            while k + 1 < len(parts):
                middle, radius = (parts[k] + parts[k + 1]) / 2, (parts[k + 1] - parts[k]) / 2 * (1 - 1e-9)
                if any(math.hypot(d, v - middle) < radius for d, v in itertools.takewhile(lambda x, r=radius: x[0] < r, near)):
                    self.halve(side, k)
                else:
                    k += 1

    def halve(self, side: tuple, k: int) -> None:
        axis, fixed, _, parts = side
        middle = (parts[k] + parts[k + 1]) / 2
        parts.insert(k + 1, middle)
        self.mesh.add((middle, fixed) if axis == 0 else (fixed, middle))

    def keeps_off(self, p: tuple[float, float]) -> bool:
        """Whether p is outside the box or within a part's circle; then that part is halved."""
        for side in self.sides:
            axis, fixed, sign, parts = side
            along, across = p[axis], (p[1 - axis] - fixed) * sign
            k = min(max(bisect.bisect_right(parts, along) - 1, 0), len(parts) - 2)
            if k >= 0 and (across < 0 or math.hypot(along - (parts[k] + parts[k + 1]) / 2, across) < (parts[k + 1] - parts[k]) / 2 * (1 - 1e-9)):
                self.halve(side, k)
                return True
        return False


def refine(points: DataFrame, min_angle: float = MIN_ANGLE) -> DataFrame:
    """Triangles (x1 .. y3) of the points' box without an angle below ``min_angle``: as long as there
    is one, its circle's centre is added, or where that would come too near to the border, the middle
    of the part of the border it is near to. The box's corners are added first."""
    limit = math.cos(math.radians(min_angle))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({c: [] for c in CORNERS})
        pdf = _in_order(pdf.astype({"x": float, "y": float}))
        (lx, ly), (hx, hy) = pdf[["x", "y"]].min(), pdf[["x", "y"]].max()
        mesh = Triangulation((lx, ly), (hx, hy))
        for p in [(lx, ly), (lx, hy), (hx, ly), (hx, hy), *pdf[["x", "y"]].itertuples(index=False, name=None)]:
            mesh.add(p)
        border = Border(mesh, (lx, ly), (hx, hy))

        def sharp(t) -> bool:
            a, b, c = (mesh.points[i] for i in mesh.triangles[t])
            for p, q, r in ((a, b, c), (b, c, a), (c, a, b)):
                u, v = (q[0] - p[0], q[1] - p[1]), (r[0] - p[0], r[1] - p[1])
                if u[0] * v[0] + u[1] * v[1] > limit * math.hypot(*u) * math.hypot(*v):
                    return True
            return False

        good: set[int] = set()
        while todo := [t for t in mesh.triangles if t not in good and min(mesh.triangles[t]) > 2]:
            for t in todo:
                if t not in mesh.triangles:
                    continue
                if not sharp(t):
                    good.add(t)
                    continue
                (ax, ay), (bx, by), (cx, cy) = (mesh.points[i] for i in mesh.triangles[t])
                d = 2 * ((bx - ax) * (cy - ay) - (cx - ax) * (by - ay))
                b2, c2 = (bx - ax) ** 2 + (by - ay) ** 2, (cx - ax) ** 2 + (cy - ay) ** 2
                new = (ax + ((cy - ay) * b2 - (by - ay) * c2) / d, ay + ((bx - ax) * c2 - (cx - ax) * b2) / d) if d else None
                if new is None or not border.keeps_off(new) and mesh.add(new) is None:
                    good.add(t)  # flat, or its centre is a point already: numbers as near as floats are
        rows = [sum((mesh.points[i] for i in t), ()) for t in mesh.triangles.values() if min(t) > 2]
        return pd.DataFrame(sorted(rows), columns=CORNERS)

    return in_one_task(_bounded(points), kernel, ", ".join(f"{c} double" for c in CORNERS))


def not_empty_circles(ele: DataFrame, node: DataFrame) -> DataFrame:
    """Certificate: each triangle against the opposite corners of its neighbours, which is enough for
    a triangulation to be Delaunay. (violations)"""
    full = with_corners(ele, node)
    by_id = full.select("id", "p1", "p2", "p3", *CORNERS)
    pairs = mesh_adjacency(ele)
    met = pairs.union(pairs.select("b", "a")).join(by_id.withColumnRenamed("id", "a"), "a")
    other = ele.select(F.col("id").alias("b"), F.array("p1", "p2", "p3").alias("o"))
    far = met.join(other, "b").withColumn("q", F.array_except("o", F.array("p1", "p2", "p3"))[0])
    placed = far.join(node.select(F.col("id").alias("q"), F.col("x").alias("qx"), F.col("y").alias("qy")), "q")
    return placed.agg(F.count_if(in_circle(*corners(), F.col("qx"), F.col("qy")) > 1e-9).alias("violations"))


def _points(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), *(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xy")))


def _strip(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    node = _points(spark, sf_dir)
    ids = node.agg(F.max("id").alias("m")).select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("m") - 1)).alias("id"))
    return ids.select("id", (F.col("id") - 1).alias("p1"), F.col("id").alias("p2"), (F.col("id") + 1).alias("p3")), node


def _q_angle(spark, sf_dir):
    return with_corners(*_strip(spark, sf_dir)).select("id", is_bad(*corners()).alias("bad"), is_obtuse(*corners()).alias("obtuse"))


def _q_incircle(spark, sf_dir):
    ele, node = _strip(spark, sf_dir)
    full = with_corners(ele, node).join(node.select((F.col("id") - 2).alias("id"), F.col("x").alias("px"), F.col("y").alias("py")), "id")
    o = orientation(*corners())
    return full.select("id", (o > 0).alias("left_turn"), (in_circle(*corners(), F.col("px"), F.col("py")) * F.signum(o) > 0).alias("inside"))


def _q_near(spark, sf_dir):
    return nearest(_points(spark, sf_dir), True).select("id", "near", F.round("d2", 12).alias("d2"))


def _q_some_near(spark, sf_dir):
    """The neighbours found without ``exact``: none farther than 3 times the nearest one."""
    own = _points(spark, sf_dir)
    exact = nearest(own, True).select("id", F.col("d2").alias("least"))
    met = nearest(own, False).join(exact, "id")
    return met.agg(F.count("*").alias("n"), F.count_if(F.col("near") == F.col("id")).alias("own"), F.count_if(F.col("d2") > 9 * F.col("least")).alias("beyond"), F.count_if(F.col("d2") < F.col("least") - 1e-12).alias("nearer"))


def _q_kd(spark, sf_dir):
    return kd_leaves(_points(spark, sf_dir)).groupBy("leaf").agg(F.count("*").alias("n"), F.min("id").alias("first"))


def _q_dt(spark, sf_dir):
    node = _points(spark, sf_dir)
    ele = materialize(delaunay(node), "triangles")
    turned = with_corners(ele, node).agg(F.count_if(orientation(*corners()) <= 0).alias("clockwise"))
    used = ele.select(F.explode(F.array("p1", "p2", "p3"))).distinct().agg(F.count("*").alias("corners"))
    return not_empty_circles(ele, node).crossJoin(turned).crossJoin(used)


def _q_dmr(spark, sf_dir):
    """No angle is below 30 degrees, every point is a corner, and the triangles cover the box."""
    own = materialize(refine(_points(spark, sf_dir)), "refined")
    ends = own.select(F.explode(F.array(*(F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (1, 2, 3)))).alias("p")).select("p.*").distinct()
    lost = _points(spark, sf_dir).join(ends, ["x", "y"], "left_anti").agg(F.count("*").alias("lost"))
    return own.agg(F.count_if(is_bad(*corners())).alias("bad_left"), F.round(F.sum(orientation(*corners()) / 2), 6).alias("area")).crossJoin(lost)


QUERIES = {
    "geo_angle": _q_angle,
    "geo_incircle": _q_incircle,
    "mesh_adj": lambda s, d: mesh_adjacency(_strip(s, d)[0]),
    "mesh_refine_stats": lambda s, d: refine_stats(*_strip(s, d)),
    "nn_exact_quad": _q_near,
    "nn_quad": _q_some_near,
    "kd_build": _q_kd,
    "dt": _q_dt,
    "dmr": _q_dmr,
}
_P = "p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"
_E = "e AS (SELECT b.id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, c.x AS x3, c.y AS y3 FROM p a JOIN p b ON b.id = a.id + 1 JOIN p c ON c.id = b.id + 1)"


def _cos(p: int, q: int, r: int) -> str:
    u, v = (f"(x{q} - x{p})", f"(y{q} - y{p})"), (f"(x{r} - x{p})", f"(y{r} - y{p})")
    return f"({u[0]} * {v[0]} + {u[1]} * {v[1]}) / sqrt(({u[0]} * {u[0]} + {u[1]} * {u[1]}) * ({v[0]} * {v[0]} + {v[1]} * {v[1]}))"


_BAD = f"greatest({_cos(1, 2, 3)}, {_cos(2, 1, 3)}, {_cos(3, 1, 2)}) > cos(radians(30))"
ORACLES = {
    "geo_angle": f"WITH {_P}, {_E} SELECT id, {_BAD} AS bad, least({_cos(1, 2, 3)}, {_cos(2, 1, 3)}, {_cos(3, 1, 2)}) < 0 AS obtuse FROM e",
    "geo_incircle": f"""WITH {_P}, {_E}, q AS (SELECT e.*, (x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1) AS o, x1 - x AS a, y1 - y AS b, x2 - x AS c, y2 - y AS d, x3 - x AS f, y3 - y AS g FROM e JOIN p ON p.id = e.id + 2)
SELECT id, o > 0 AS left_turn, ((a * a + b * b) * (c * g - f * d) - (c * c + d * d) * (a * g - f * b) + (f * f + g * g) * (a * d - c * b)) * sign(o) > 0 AS inside FROM q""",
    "mesh_adj": "WITH m AS (SELECT max(vec_id) AS m FROM embeddings) SELECT vec_id AS a, vec_id + 1 AS b FROM embeddings, m WHERE vec_id BETWEEN 1 AND m - 2",
    "mesh_refine_stats": f"WITH {_P}, {_E} SELECT count(*) AS elements, count(*) FILTER ({_BAD}) AS bad FROM e",
    "nn_exact_quad": f"""WITH {_P} SELECT a.id, arg_min(b.id, ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id)) AS near,
  round(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 12) AS d2 FROM p a JOIN p b ON a.id <> b.id GROUP BY 1""",
    "nn_quad": "SELECT count(*) AS n, CAST(0 AS BIGINT) AS own, CAST(0 AS BIGINT) AS beyond, CAST(0 AS BIGINT) AS nearer FROM embeddings",
    "kd_build": f"""WITH RECURSIVE {_P}, t(it, id, x, y, leaf) AS (SELECT 0, id, x, y, CAST(1 AS BIGINT) FROM p UNION ALL
  SELECT t.it + 1, t.id, t.x, t.y, 2 * t.leaf + CAST(CASE WHEN s.w >= s.h THEN t.x > s.mx ELSE t.y > s.my END AS BIGINT) FROM t JOIN
  (SELECT leaf, max(x) - min(x) AS w, max(y) - min(y) AS h, quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my FROM t GROUP BY 1 HAVING count(*) > 32 AND greatest(max(x) - min(x), max(y) - min(y)) > 0) s USING (leaf)),
l AS (SELECT id, arg_max(leaf, it) AS leaf FROM t GROUP BY 1) SELECT leaf, count(*) AS n, min(id) AS "first" FROM l GROUP BY 1""",
    "dt": f"WITH {_P} SELECT CAST(0 AS BIGINT) AS violations, CAST(0 AS BIGINT) AS clockwise, count(DISTINCT (x, y)) AS corners FROM p",
    "dmr": f"WITH {_P} SELECT CAST(0 AS BIGINT) AS bad_left, round((max(x) - min(x)) * (max(y) - min(y)), 6) AS area, CAST(0 AS BIGINT) AS lost FROM p",
}
