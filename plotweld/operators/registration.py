"""Registration: fits by sums over the cluster, residual statistics, the kernels of small point sets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def helmert(points: DataFrame) -> DataFrame:
    """Scale, rotation and shift of sx, sy -> tx, ty as one row."""
    c = points.agg(*(F.avg(x).alias(f"m_{x}") for x in ("sx", "sy", "tx", "ty")))
    ax, ay, bx, by = (F.col(x) - F.col(f"m_{x}") for x in ("sx", "sy", "tx", "ty"))
    dx = ax + 1e-12
    norm = dx * dx + ay * ay
    re, im = (bx * dx + by * ay) / norm, (by * dx - bx * ay) / norm
    sums = points.crossJoin(F.broadcast(c)).agg(*(F.first(f"m_{x}").alias(f"m_{x}") for x in ("sx", "sy", "tx", "ty")), F.sqrt(F.sum(bx * bx + by * by) / F.sum(ax * ax + ay * ay)).alias("scale"), F.atan2(F.sum(im), F.sum(re)).alias("rotation"))
    a, b = F.col("scale") * F.cos("rotation"), F.col("scale") * F.sin("rotation")
    return sums.select("scale", "rotation", (F.col("m_tx") - (a * F.col("m_sx") - b * F.col("m_sy"))).alias("shift_x"), (F.col("m_ty") - (b * F.col("m_sx") + a * F.col("m_sy"))).alias("shift_y"))


def affine(points: DataFrame) -> DataFrame:
    """Six least-squares parameters from centred second moments, as one row."""
    m = points.agg(*(F.avg(x).alias(f"m_{x}") for x in ("sx", "sy", "tx", "ty")))
    sx, sy, tx, ty = (F.col(x) - F.col(f"m_{x}") for x in ("sx", "sy", "tx", "ty"))
    sums = points.crossJoin(F.broadcast(m)).agg(
        *(F.first(f"m_{x}").alias(f"m_{x}") for x in ("sx", "sy", "tx", "ty")),
        F.sum(sx * sx).alias("xx"), F.sum(sx * sy).alias("xy"), F.sum(sy * sy).alias("yy"), F.sum(sx * tx).alias("xu"), F.sum(sy * tx).alias("yu"), F.sum(sx * ty).alias("xv"), F.sum(sy * ty).alias("yv"),
    )
    det = F.nullif(F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy"), F.lit(0.0))
    solve = lambda u, v: ((F.col(u) * F.col("yy") - F.col(v) * F.col("xy")) / det, (F.col("xx") * F.col(v) - F.col("xy") * F.col(u)) / det)
    (a, b), (c, d) = solve("xu", "yu"), solve("xv", "yv")
    out = sums.withColumns({"a": a, "b": b, "c": c, "d": d})
    return out.select("a", "b", (F.col("m_tx") - F.col("a") * F.col("m_sx") - F.col("b") * F.col("m_sy")).alias("e"), "c", "d", (F.col("m_ty") - F.col("c") * F.col("m_sx") - F.col("d") * F.col("m_sy")).alias("f"))


def apply_affine(rows: DataFrame, fit: DataFrame, x: str = "sx", y: str = "sy") -> DataFrame:
    """One matrix for the whole layer."""
    moved = rows.crossJoin(F.broadcast(fit))
    return moved.withColumn("px", F.col("a") * F.col(x) + F.col("b") * F.col(y) + F.col("e")).withColumn("py", F.col("c") * F.col(x) + F.col("d") * F.col(y) + F.col("f")).drop("a", "b", "c", "d", "e", "f")


def with_residual(rows: DataFrame) -> DataFrame:
    dx, dy = F.col("px") - F.col("tx"), F.col("py") - F.col("ty")
    return rows.withColumn("residual", F.sqrt(dx * dx + dy * dy))


def with_region(rows: DataFrame, bins: int = 3) -> DataFrame:
    """r{row}c{col} labels of a bins x bins grid over the extent."""
    e = rows.agg(F.min("sx").alias("x0"), F.max("sx").alias("x1"), F.min("sy").alias("y0"), F.max("sy").alias("y1"))
    cell = lambda v, a, b: F.least(F.floor((F.col(v) - F.col(a)) / F.greatest(F.col(b) - F.col(a), F.lit(1e-9)) * bins), F.lit(bins - 1)).cast("int")
    out = rows.crossJoin(F.broadcast(e)).withColumn("row", cell("sy", "y0", "y1")).withColumn("col", cell("sx", "x0", "x1")).drop("x0", "x1", "y0", "y1")
    return out.withColumn("region", F.concat(F.lit("r"), F.col("row"), F.lit("c"), F.col("col")))


def helmert_matrix(fit: DataFrame) -> DataFrame:
    """The similarity as the six parameters of an affine map."""
    a, b = F.col("scale") * F.cos("rotation"), F.col("scale") * F.sin("rotation")
    return fit.select(a.alias("a"), (-b).alias("b"), F.col("shift_x").alias("e"), b.alias("c"), a.alias("d"), F.col("shift_y").alias("f"))


def gate(rows: DataFrame, threshold: float = 0.5, regional: float = 1.5) -> DataFrame:
    """One row: global P95, worst regional P95, and whether both keep their bounds; without residuals nothing passes."""
    worst = rows.groupBy("region").agg(F.percentile("residual", 0.95).alias("p95")).agg(F.max("p95").alias("worst_p95"), F.count(F.when(F.col("p95") <= regional * threshold, 1)).alias("passing_regions"), F.count(F.when(F.col("p95") > regional * threshold, 1)).alias("failing_regions"))
    total = rows.agg(F.count("*").alias("n"), F.percentile("residual", 0.95).alias("p95"), F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rmse"))
    return total.crossJoin(F.broadcast(worst)).withColumn("passed", F.coalesce((F.col("failing_regions") == 0) & (F.col("p95") <= threshold), F.lit(False)))


def single_shot(points: DataFrame, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(fit, gate) of the affine map; of fewer than three points, whose map is not determined, nothing passes."""
    fit = affine(points)
    return fit, gate(with_region(with_residual(apply_affine(points, fit))), threshold)


def residual_vectors(rows: DataFrame) -> DataFrame:
    """From each point to where the map takes it."""
    return rows.select("point_id", F.col("sx").alias("from_x"), F.col("sy").alias("from_y"), F.col("px").alias("to_x"), F.col("py").alias("to_y"), "residual")


def heatmap_cells(rows: DataFrame, bins: int = 3) -> DataFrame:
    """The heat map's cells that hold points, with bounds and the share of the mean in the P95, 1 at most."""
    e = rows.agg(F.min("sx").alias("x0"), F.max("sx").alias("x1"), F.min("sy").alias("y0"), F.max("sy").alias("y1"))
    cells = heatmap(rows, bins).where("n > 0").crossJoin(F.broadcast(e))
    at = lambda a, b, k: F.col(a) + (F.col(b) - F.col(a)) * k / bins
    share = F.least(F.col("mean") / F.greatest("p95", F.lit(0.01)), F.lit(1.0))
    return cells.select("row", "col", "n", "mean", "p95", share.alias("residual"), at("x0", "x1", F.col("col")).alias("xmin"), at("y0", "y1", F.col("row")).alias("ymin"), at("x0", "x1", F.col("col") + 1).alias("xmax"), at("y0", "y1", F.col("row") + 1).alias("ymax"))


def regional_stats(rows: DataFrame) -> DataFrame:
    r = F.col("residual")
    return rows.groupBy("region").agg(F.count("*").alias("n"), F.sqrt(F.avg(r * r)).alias("rmse"), F.percentile(r, 0.5).alias("p50"), F.percentile(r, 0.95).alias("p95"), F.max(r).alias("max"))


def regional_sketch(rows: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """Quantiles by region from sketches that merge: each is a residual whose rank is off by n / accuracy at most."""
    both = F.percentile_approx("residual", [0.5, 0.95], accuracy)
    return rows.groupBy("region").agg(F.count("*").alias("n"), both.alias("q")).select("region", "n", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"))


def heatmap(rows: DataFrame, bins: int = 3) -> DataFrame:
    """All cells of the grid, empty ones with nulls."""
    grid = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("col"))
    stats = rows.groupBy("row", "col").agg(F.count("*").alias("n"), F.avg("residual").alias("mean"), F.percentile("residual", 0.95).alias("p95"))
    return grid.join(stats, ["row", "col"], "left").fillna(0, ["n"])


def helmert_fit(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The 3 x 3 matrix of the similarity, for small point sets."""
    a, b = src - src.mean(0), dst - dst.mean(0)
    za, zb = a[:, 0] + 1j * a[:, 1], b[:, 0] + 1j * b[:, 1]
    z = np.linalg.norm(b) / max(np.linalg.norm(a), 1e-12) * np.exp(1j * np.angle((zb / (za + 1e-12)).sum()))
    m = np.array([[z.real, -z.imag, 0.0], [z.imag, z.real, 0.0], [0.0, 0.0, 1.0]])
    m[:2, 2] = dst.mean(0) - m[:2, :2] @ src.mean(0)
    return m


def kernel(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    r2 = (p[:, None, 0] - q[None, :, 0]) ** 2
    r2 += (p[:, None, 1] - q[None, :, 1]) ** 2
    k = np.log(np.maximum(r2, 1e-300))
    k *= r2
    k *= 0.5
    return k


def spline_weights(src: np.ndarray, dst: np.ndarray, smoothing: float = 0.1) -> np.ndarray:
    """Weights of a thin-plate spline with smoothing, a row a point, then the constant and the two slopes of its tail."""
    n = len(src)
    k = np.zeros((n + 3, n + 3))
    k[:n, :n] = kernel(src, src) + smoothing * np.eye(n)
    k[:n, n], k[:n, n + 1 :] = 1, src
    k[n:, :n] = k[:n, n:].T
    return np.linalg.solve(k, np.r_[dst, np.zeros((3, 2))])


def spline(src: np.ndarray, dst: np.ndarray, smoothing: float = 0.1):
    """The spline as a function of points."""
    n, w = len(src), spline_weights(src, dst, smoothing)
    return lambda p: kernel(p, src) @ w[:n] + np.c_[np.ones(len(p)), p] @ w[n:]
