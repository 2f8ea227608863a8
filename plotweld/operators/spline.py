"""Thin-plate spline with smoothing through every point of a table, fitted and evaluated in parts.

Up to DIRECT points are one dense system. More are solved by generalised conjugate residuals: each round solves overlapping
blocks of neighbours and a coarse set, which only steer it, and multiplies by the whole kernel, summed for a group of places and a group of
sources at a time. No task holds all points and nothing is n x n. Rounds end when no residual is over TOLERANCE of the largest
that the affine map leaves; if ROUNDS do not get there, an error is raised.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import registration
from .lineage import cut

SMOOTHING = 0.1
DIRECT = 2000
TOLERANCE, ROUNDS = 1e-8, 100
PLACES, SOURCES, TASKS = 2000, 16_000, 512  # places and sources in a group, groups of both in a task
BLOCK, MARGIN, SIDE, AROUND, COARSE = 500, 0.5, 100, 1500, 1000  # points of a block, its rim, points of the rim from one block and in all
PAIR = ("u", "v")


def _products(places: DataFrame, keys: list[str], sources: DataFrame) -> DataFrame:
    """keys, u, v: at each place x, y the kernel to every source (id, x, y, u, v) times its weights, summed."""
    n, cols = places.count(), max(1, -(-sources.count() // SOURCES))
    rows = max(1, -(-n // min(PLACES, max(100, n * cols // 32))))  # some 32 groups at least, where there are places enough
    tasks = min(rows * cols, TASKS)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda ids, n: F.pmod(F.xxhash64(*ids), F.lit(n)).cast("int")
    left = places.select(*keys, "x", "y", part(keys, rows).alias("i")).select("*", every(cols).alias("j")).repartition(tasks, "i", "j")
    right = sources.select("x", "y", *PAIR, part(["id"], cols).alias("j")).select("*", every(rows).alias("i")).repartition(tasks, "i", "j")

    def add(at: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        p, q, w = at[["x", "y"]].to_numpy(), near[["x", "y"]].to_numpy(), near[list(PAIR)].to_numpy()
        parts = [registration.kernel(p[k : k + 128], q) @ w for k in range(0, len(p), 128)]
        return at[keys].join(pd.DataFrame(np.concatenate(parts) if parts else np.zeros((0, 2)), columns=PAIR, index=at.index))

    kinds = ", ".join(f"{k} {places.schema[k].dataType.simpleString()}" for k in keys)
    sums = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(add, f"{kinds}, u double, v double")
    return sums.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in PAIR))


def _blocks(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The points with their block, and the blocks' boxes: halved at the median of the longer side until none has more than BLOCK."""
    rows = points.withColumn("block", F.lit(1).cast("bigint"))
    while True:
        rows = cut(rows)
        span = lambda c: (F.min(c).alias(f"{c}0"), F.max(c).alias(f"{c}1"), F.percentile_approx(c, 0.5).alias(f"{c}m"))
        boxes = cut(rows.groupBy("block").agg(F.count("*").alias("n"), *span("x"), *span("y")))
        if boxes.agg(F.max("n")).first()[0] <= BLOCK:
            return rows, boxes.select("block", "x0", "x1", "y0", "y1")
        wide = F.col("x1") - F.col("x0") >= F.col("y1") - F.col("y0")
        side = lambda c: F.when(F.col(f"{c}1") == F.col(f"{c}0"), F.pmod(F.xxhash64("id", "block"), F.lit(2)) == 1).when(F.col(f"{c}1") > F.col(f"{c}m"), F.col(c) > F.col(f"{c}m")).otherwise(F.col(c) >= F.col(f"{c}m"))
        half = F.when(wide, side("x")).otherwise(side("y")).cast("bigint")
        rows = rows.join(F.broadcast(boxes), "block").withColumn("block", F.when(F.col("n") > BLOCK, 2 * F.col("block") + half).otherwise(F.col("block"))).select(*rows.columns)


def _members(rows: DataFrame, boxes: DataFrame) -> DataFrame:
    """block, id, x, y, inner: the points of each block and of its rim, the nearest of every block around it in turn."""
    out = lambda c: F.greatest(F.col(f"{c}0") - F.col(c), F.col(c) - F.col(f"{c}1"), F.lit(0.0))
    off = F.sqrt(out("x") * out("x") + out("y") * out("y"))
    inner = F.col("own") == F.col("block")
    near = rows.select("id", "x", "y", F.col("block").alias("own")).join(F.broadcast(boxes), inner | (off <= MARGIN * F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))))
    near = near.select("block", "own", "id", "x", "y", inner.alias("inner"), off.alias("off"))
    near = near.withColumn("k", F.row_number().over(W.partitionBy("block", "own").orderBy("off", "id"))).where(F.col("inner") | (F.col("k") <= SIDE))
    ranked = near.withColumn("k", F.row_number().over(W.partitionBy("block").orderBy(F.desc("inner"), "k", "off", "id")))
    return ranked.where(F.col("k") <= BLOCK + AROUND).select("block", "id", "x", "y", "inner")


def _solved(frame: pd.DataFrame) -> pd.DataFrame:
    """Weights without moments that leave u, v of a few points but for a plane; of points on a line or a place, but for what these have of it."""
    at, d = frame[["x", "y"]].to_numpy(), frame[list(PAIR)].to_numpy()
    n, off = len(at), at - at.mean(0)
    basis, s, _ = np.linalg.svd(np.c_[np.ones(n), off / max(np.abs(off).max(), 1e-9)], full_matrices=False)
    basis = basis[:, s > 1e-9 * s[0]]
    a = registration.kernel(at, at) + SMOOTHING * np.eye(n)
    a -= basis @ (basis.T @ a)
    a -= (a @ basis) @ basis.T
    z = np.linalg.solve(a + max(np.abs(a).max(), SMOOTHING) * basis @ basis.T, d - basis @ (basis.T @ d))
    z -= basis @ (basis.T @ z)
    return frame[["id"]].join(pd.DataFrame(z, columns=PAIR, index=frame.index))[frame["inner"].to_numpy()]


SOLVED = "id bigint, u double, v double"


def _plane(rows: DataFrame) -> tuple[list[Column], np.ndarray, tuple[float, float, float]]:
    """1, x, y as columns of like size, their products with each other, and what was taken from x and y and what divides them."""
    e = rows.agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-9)).alias("s")).first()
    basis = [F.lit(1.0), (F.col("x") - e.x) / e.s, (F.col("y") - e.y) / e.s]
    gram = np.array(rows.agg(*(F.sum(a * b) for a in basis for b in basis)).first()).reshape(3, 3)
    if np.linalg.matrix_rank(gram, 1e-12 * gram[0, 0]) < 3:
        raise ValueError("a spline needs points that are not all on one line")
    return basis, gram, (e.x, e.y, e.s)


def _numbers(rows: DataFrame, sums: list[Column]) -> np.ndarray:
    """Sums over all rows, two by two."""
    return np.array(rows.agg(*(F.sum(c) for c in sums)).first(), float).reshape(-1, 2)


def _without(c: str, column: int, basis: list[Column], part: np.ndarray) -> Column:
    return F.col(c) - sum((b * float(p[column]) for b, p in zip(basis, part, strict=True)), F.lit(0.0))


def _weights(points: DataFrame) -> DataFrame:
    """id, x, y, u, v: the weights of points id, x, y, tx, ty, by rounds."""
    basis, gram, _ = _plane(points)
    rows, boxes = _blocks(points)
    members = cut(_members(rows, boxes))
    blocks = boxes.count()
    hashed = F.xxhash64("id")
    few = rows.withColumn("k", F.row_number().over(W.partitionBy("block").orderBy(hashed, "id"))).where(F.col("k") <= -(-COARSE // blocks))
    coarse = cut(few.orderBy("k", hashed, "id").limit(COARSE).select("id", "x", "y"))
    fitted = lambda sums: np.linalg.solve(gram, sums)
    flat = lambda frame, names: fitted(_numbers(frame, [b * F.col(c) for b in basis for c in names]))
    over = flat(points, ("tx", "ty"))
    none = F.array().cast("array<struct<u:double,v:double>>")
    state = cut(points.select("id", "x", "y", F.lit(0.0).alias("wu"), F.lit(0.0).alias("wv"), *(_without(c, i, basis, over).alias(r) for i, (c, r) in enumerate((("tx", "ru"), ("ty", "rv")))), none.alias("zs"), none.alias("qs")))
    worst = lambda: state.agg(F.max(F.greatest(F.abs("ru"), F.abs("rv")))).first()[0]
    first = last = worst()
    left = state.select("id", F.col("ru").alias("u"), F.col("rv").alias("v"))
    for k in range(ROUNDS + 1):
        if last <= TOLERANCE * first:
            return state.select("id", "x", "y", F.col("wu").alias("u"), F.col("wv").alias("v"))
        if k == ROUNDS:
            break
        # the blocks, then the coarse set on what they leave
        near = cut(members.join(left, "id").repartition(min(blocks, TASKS), "block").groupBy("block").applyInPandas(_solved, SOLVED).join(points.select("id", "x", "y"), "id"))
        part = flat(near, PAIR)
        near = cut(near.select("id", "x", "y", *(_without(c, i, basis, part).alias(c) for i, c in enumerate(PAIR))))
        there = _products(coarse, ["id"], near).join(near.select("id", *(F.col(c).alias(f"z{c}") for c in PAIR)), "id").join(left.select("id", *(F.col(c).alias(f"r{c}") for c in PAIR)), "id")
        there = there.join(coarse, "id").select("id", "x", "y", F.lit(True).alias("inner"), *((F.col(f"r{c}") - F.col(c) - SMOOTHING * F.col(f"z{c}")).alias(c) for c in PAIR))
        far = there.groupBy().applyInPandas(_solved, SOLVED).select("id", *(F.col(c).alias(f"f{c}") for c in PAIR))
        z = cut(near.join(far, "id", "left").select("id", "x", "y", *((F.col(c) + F.coalesce(f"f{c}", F.lit(0.0))).alias(c) for c in PAIR)))
        # the whole kernel
        q = _products(z, ["id"], z).select("id", *(F.col(c).alias(f"q{c}") for c in PAIR))
        trial = cut(state.join(z.select("id", *(F.col(c).alias(f"z{c}") for c in PAIR)), "id").join(q, "id").withColumns({f"q{c}": F.col(f"q{c}") + SMOOTHING * F.col(f"z{c}") for c in PAIR}))
        earlier = lambda a, i, c: F.col(a)[i][c]
        sums = _numbers(trial, [b * F.col(f"q{c}") for b in basis for c in PAIR] + [earlier("qs", i, c) * F.col(f"q{c}") for i in range(k) for c in PAIR])
        part, like = fitted(sums[:3]), sums[3:]
        less = lambda a, i, c, start: start - sum((earlier(a, j, c) * float(like[j, i]) for j in range(k)), F.lit(0.0))  # noqa: E731, B023
        trial = trial.withColumns({f"q{c}": less("qs", i, c, _without(f"q{c}", i, basis, part)) for i, c in enumerate(PAIR)} | {f"z{c}": less("zs", i, c, F.col(f"z{c}")) for i, c in enumerate(PAIR)})
        norm, step = _numbers(trial, [F.col(f"q{c}") * F.col(f"q{c}") for c in PAIR] + [F.col(f"q{c}") * F.col(f"r{c}") for c in PAIR])
        norm = np.where(norm > 0, np.sqrt(norm), 1.0)
        step = step / norm
        unit = lambda a: F.struct(*((F.col(f"{a}{c}") / float(norm[i])).alias(c) for i, c in enumerate(PAIR)))  # noqa: E731, B023
        moved = lambda a, b, sign: [(F.col(f"{a}{c}") + F.col(f"{b}{c}") * (sign * float(step[i] / norm[i]))).alias(f"{a}{c}") for i, c in enumerate(PAIR)]  # noqa: E731, B023
        state = cut(trial.select("id", "x", "y", *moved("w", "z", 1), *moved("r", "q", -1), F.array_append("zs", unit("z")).alias("zs"), F.array_append("qs", unit("q")).alias("qs")))
        left = state.select("id", F.col("ru").alias("u"), F.col("rv").alias("v"))
        last = worst()
    raise ValueError(f"the spline's residual is {last} after {ROUNDS} rounds, {first} before")


def fit(points: DataFrame) -> tuple[DataFrame, list[float]]:
    """Weights (id, x, y, u, v) of points id, x, y, tx, ty, each id once, and the tail: constant and slopes of x, then of y."""
    points = cut(points.select(F.col("id").cast("bigint").alias("id"), "x", "y", "tx", "ty"))
    if points.count() <= DIRECT:

        def solve(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["x", "y", "tx", "ty"])
            w = registration.spline_weights(rows[["x", "y"]].to_numpy(), rows[["tx", "ty"]].to_numpy(), SMOOTHING)
            weights = rows[["id", "x", "y"]].assign(u=w[:-3, 0], v=w[:-3, 1])
            return pd.DataFrame({"weights": [weights.to_dict("records")], "tail": [w[-3:].T.ravel().tolist()]})

        one = cut(points.groupBy().applyInPandas(solve, "weights array<struct<id: bigint, x: double, y: double, u: double, v: double>>, tail array<double>"))
        return one.select(F.inline("weights")), one.first().tail
    weights = _weights(points)
    basis, gram, (mx, my, s) = _plane(points)
    own = weights.select("id", *(F.col(c).alias(f"w{c}") for c in PAIR))
    rest = cut(_products(points, ["id"], weights).join(own, "id").join(points, "id").select("x", "y", *((F.col(t) - F.col(c) - SMOOTHING * F.col(f"w{c}")).alias(c) for c, t in (("u", "tx"), ("v", "ty")))))
    level, *slopes = np.linalg.solve(gram, _numbers(rest, [b * F.col(c) for b in basis for c in PAIR]))
    a, b = (m / s for m in slopes)
    return weights, np.array([level - a * mx - b * my, a, b]).T.ravel().tolist()


def moved(places: DataFrame, keys: list[str], weights: DataFrame, tail: list[float]) -> DataFrame:
    """keys, to: where the spline takes each place x, y, as a struct x, y; null where a coordinate is."""
    whole = places.where("x is not null and y is not null")
    sums = _products(whole, keys, weights)
    to = [(F.col(c) + tail[i] + tail[i + 1] * F.col("x") + tail[i + 2] * F.col("y")).alias(n) for c, n, i in (("u", "x", 0), ("v", "y", 3))]
    return whole.join(sums, keys).select(*keys, F.struct(*to).alias("to"))
