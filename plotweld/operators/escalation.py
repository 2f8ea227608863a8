"""Registration by escalation, as plans: robust choice of points, similarity, affine map, spline.

Points have point_id, sx, sy, tx, ty. What is broadcast has a fixed size: one row of fits, at most ITERATIONS sample models;
these few rows are written out, so that later steps do not repeat the earlier ones. The spline is fitted to all points
(`spline.py`), only where the maps before it fail; its weights are a table, which the row of the step names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import registration, spline
from .lineage import cut, written

ITERATIONS = 500
SAMPLE = 3
BOUNDING = 2000  # points whose checksums bound those of a sample
MATRIX = ("a", "b", "e", "c", "d", "f")
STEPS = {"helmert": (1, 1.5), "affine": (2, 1.5), "tps": (3, 2.0)}


def similarity(points: Column) -> Column:
    """Scale and mean turn of an array of sx, sy, tx, ty as the six numbers of an affine map."""
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda acc, p: acc + f(p))
    mean = {c: total(points, lambda p, c=c: p[c]) / F.size(points) for c in ("sx", "sy", "tx", "ty")}
    middle = F.transform(points, lambda p: F.struct(*((p[c] - mean[c]).alias(c) for c in mean)))
    near = lambda p: p["sx"] + 1e-12
    norm = lambda p: near(p) * near(p) + p["sy"] * p["sy"]
    re = total(middle, lambda p: (p["tx"] * near(p) + p["ty"] * p["sy"]) / norm(p))
    im = total(middle, lambda p: (p["ty"] * near(p) - p["tx"] * p["sy"]) / norm(p))
    scale = F.sqrt(total(middle, lambda p: p["tx"] * p["tx"] + p["ty"] * p["ty"]) / F.nullif(total(middle, lambda p: p["sx"] * p["sx"] + p["sy"] * p["sy"]), F.lit(0.0)))
    a, b = scale * F.cos(F.atan2(im, re)), scale * F.sin(F.atan2(im, re))
    return F.struct(a.alias("a"), (-b).alias("b"), (mean["tx"] - a * mean["sx"] + b * mean["sy"]).alias("e"), b.alias("c"), a.alias("d"), (mean["ty"] - b * mean["sx"] - a * mean["sy"]).alias("f"))


def miss(m: Column) -> Column:
    """How far a map takes a point from its target."""
    dx = m["a"] * F.col("sx") + m["b"] * F.col("sy") + m["e"] - F.col("tx")
    dy = m["c"] * F.col("sx") + m["d"] * F.col("sy") + m["f"] - F.col("ty")
    return F.sqrt(dx * dx + dy * dy)


def sample_models(points: DataFrame, iterations: int = ITERATIONS, seed: int = 42) -> DataFrame:
    """iteration, m: a similarity for each seeded sample, its SAMPLE points the smallest checksums of seed, iteration and point.

    The SAMPLE-th checksum among any few points bounds that of all from above, so the others are dropped as they are drawn and
    only about SAMPLE / BOUNDING of them are sorted.
    """
    tries = F.explode(F.sequence(F.lit(1), F.lit(iterations))).alias("iteration")
    checksum = F.md5(F.concat_ws(":", F.lit(seed), F.col("iteration"), F.col("point_id").cast("string"))).alias("checksum")
    by = W.partitionBy("iteration").orderBy("checksum")
    nth = lambda rows: rows.withColumn("k", F.row_number().over(by))
    few = points.select("point_id").limit(BOUNDING).select("point_id", tries).select("iteration", checksum)
    bounds = cut(nth(few).where(F.col("k") == SAMPLE).select("iteration", F.col("checksum").alias("bound")))
    bound = bounds.agg(F.array_sort(F.collect_list(F.struct("iteration", "bound"))).alias("bounds"))  # of every iteration, or none
    drawn = points.select("point_id", "sx", "sy", "tx", "ty").crossJoin(F.broadcast(bound)).select("point_id", "sx", "sy", "tx", "ty", "bounds", tries)
    drawn = drawn.select("iteration", "point_id", "sx", "sy", "tx", "ty", checksum, F.get("bounds", F.col("iteration") - 1)["bound"].alias("bound")).where("checksum <= bound")
    picked = nth(drawn.drop("bound")).where(F.col("k") <= SAMPLE)
    sets = picked.groupBy("iteration").agg(F.array_sort(F.collect_list(F.struct("k", "sx", "sy", "tx", "ty"))).alias("points"))
    return sets.where(F.size("points") == SAMPLE).select("iteration", similarity(F.col("points")).alias("m"))


def ransac(points: DataFrame, threshold: float = 2.0, iterations: int = ITERATIONS, seed: int = 42) -> DataFrame:
    """The points with `inlier`: whether the map refitted on the inliers of the best sample misses them by less than `threshold`.

    All samples are scored in one aggregate; of equal scores the earliest wins. Fewer than SAMPLE points give no rows.
    """
    tasks = min(64, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    points = points.repartition(tasks, "point_id")  # few bytes, so they would be read by one task, but each is tried ITERATIONS times
    models = cut(sample_models(points, iterations, seed))
    every = models.agg(F.collect_list(F.struct("iteration", "m")).alias("models"))
    hits = points.crossJoin(F.broadcast(every)).select(F.explode(F.transform("models", lambda x: F.struct(x["iteration"].alias("iteration"), (miss(x["m"]) < threshold).cast("int").alias("hit")))).alias("h"))
    scores = hits.groupBy("h.iteration").agg(F.sum("h.hit").alias("n"))
    best = scores.agg(F.max_by("iteration", F.struct("n", -F.col("iteration"))).alias("iteration"), F.max("n").alias("n"))
    first = cut(models.join(F.broadcast(best), "iteration").select("m", "n"))
    inside = points.crossJoin(F.broadcast(first)).where(miss(F.col("m")) < threshold).drop("m", "n")
    again = registration.helmert_matrix(registration.helmert(inside)).select(F.struct(*MATRIX).alias("again"))
    last = first.crossJoin(again).select(F.when((F.col("n") >= 2) & F.col("again.a").isNotNull(), F.col("again")).otherwise(F.col("m")).alias("m"))
    last = cut(last)
    return points.crossJoin(F.broadcast(last)).withColumn("inlier", miss(F.col("m")) < threshold).drop("m")


def _measured(residuals: DataFrame) -> DataFrame:
    """For each step: points, RMSE, P95 of all and of the worst region."""
    r = F.col("residual")
    cells = residuals.rollup("step", "region").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum(r * r).alias("ss"), F.percentile(r, 0.95).alias("p95")).where("level < 3")
    all_, one = F.col("level") == 1, F.col("level") == 0
    pick = lambda c: F.max(F.when(all_, F.col(c)))
    return cells.groupBy("step").agg(pick("n").alias("n"), F.sqrt(pick("ss") / pick("n")).alias("rmse"), pick("p95").alias("p95"), F.max(F.when(one, F.col("p95"))).alias("worst_p95"))


def _judged(steps: DataFrame, method: Column, factor: float, envelope: float) -> DataFrame:
    limit = F.lit(factor * envelope)
    return steps.select("step", method.alias("method"), "n", "rmse", "p95", "worst_p95", limit.alias("threshold"), F.coalesce((F.col("n") >= SAMPLE) & (F.col("worst_p95") <= limit), F.lit(False)).alias("accepted"))


def escalated(points: DataFrame, envelope: float = 0.5) -> DataFrame:
    """The steps tried, one row each, with what they fitted: the first whose worst regional P95 keeps its threshold is `chosen`.

    Similarity and affine map must keep 1.5 times the envelope, the spline 2 times; regions are a 3 x 3 grid over the points. If
    none does, the spline is chosen and not accepted. Fewer than three points try nothing: no rows.
    """
    regions = registration.with_region(points).where(F.col("region").isNotNull())
    maps = registration.helmert_matrix(registration.helmert(points)).select(F.struct(*MATRIX).alias("helmert")).crossJoin(registration.affine(points).select(F.struct(*MATRIX).alias("affine")))
    maps = cut(maps)
    tried = F.array(*(F.struct(F.lit(STEPS[m][0]).alias("step"), miss(F.col(m)).alias("residual")) for m in ("helmert", "affine")))
    residuals = regions.crossJoin(F.broadcast(maps)).select("region", F.explode(tried).alias("t")).select("region", "t.*")
    name = F.when(F.col("step") == 1, "helmert").otherwise("affine")
    two = _judged(_measured(residuals), name, STEPS["helmert"][1], envelope).where(F.col("n") >= SAMPLE)
    two = cut(two)
    first = two.agg(F.min(F.when(F.col("accepted"), F.col("step"))).alias("first"), F.count("*").alias("tried"))
    bent = first.first()
    two = two.crossJoin(F.broadcast(first)).where(F.col("step") <= F.coalesce("first", F.lit(2))).withColumn("chosen", F.coalesce(F.col("step") == F.col("first"), F.lit(False))).drop("first", "tried")
    two = two.crossJoin(F.broadcast(maps)).withColumn("m", F.when(F.col("step") == 1, F.col("helmert")).otherwise(F.col("affine"))).drop("helmert", "affine")
    two = two.withColumns({"weights": F.lit(None).cast("string"), "tail": F.lit(None).cast("array<double>")})
    if bent.first is not None or not bent.tried:
        return two
    numbered = cut(regions.select(F.monotonically_increasing_id().alias("id"), "region", F.col("sx").alias("x"), F.col("sy").alias("y"), "tx", "ty"))
    weights, tail = spline.fit(numbered.where("tx is not null and ty is not null"))
    off = numbered.join(spline.moved(numbered, ["id"], weights, tail), "id", "left")
    dx, dy = F.col("to.x") - F.col("tx"), F.col("to.y") - F.col("ty")
    third = _judged(_measured(off.select(F.lit(STEPS["tps"][0]).alias("step"), "region", F.sqrt(dx * dx + dy * dy).alias("residual"))), F.lit("tps"), STEPS["tps"][1], envelope)
    third = cut(third).withColumn("chosen", F.lit(True)).crossJoin(F.broadcast(maps.select(F.col("affine").alias("m"))))
    return two.unionByName(third.withColumns({"weights": F.lit(written(weights)), "tail": F.array(*map(F.lit, tail))}))


def run_record(points: DataFrame, envelope: float = 0.5) -> DataFrame:
    """One row: the chosen method, its own figures, and the conflict of a failure; method `none` and no figures for fewer than three points."""
    one = escalated(points, envelope).where("chosen").agg(*(F.first(c).alias(c) for c in ("method", "n", "rmse", "p95", "worst_p95", "accepted")))
    passed = F.coalesce("accepted", F.lit(False))
    return one.select(F.coalesce("method", F.lit("none")).alias("method"), F.coalesce("n", F.lit(0)).alias("n"), "rmse", "p95", "worst_p95", passed.alias("passed"), F.when(~passed, "REGISTRATION_FAILURE").alias("conflict_type"))


def registered(rings: DataFrame, steps: DataFrame, origin: tuple[float, float]) -> DataFrame:
    """The next version of every parcel of `rings` (parcel_id, version, ring), moved by the chosen fit about the origin.

    Status CANDIDATE, attributes replaced by the stage, uncertainty the P95 of all points under that fit. Without a
    chosen fit there is nothing to move and no row.
    """
    ox, oy = origin
    chosen = steps.where("chosen").select("m", "weights", "tail", "p95")
    named = chosen.first()
    if named is not None and named.weights is not None:
        rows = _bent(rings, rings.sparkSession.read.parquet(named.weights), list(named.tail), origin).crossJoin(F.broadcast(chosen.select("p95")))
    else:
        m = F.col("m")

        def place(v: Column) -> Column:
            x, y = v["x"] - ox, v["y"] - oy
            return F.struct((m["a"] * x + m["b"] * y + m["e"] + ox).alias("x"), (m["c"] * x + m["d"] * y + m["f"] + oy).alias("y"))

        rows = rings.crossJoin(F.broadcast(chosen)).withColumn("ring", F.transform("ring", place))
    return rows.select("parcel_id", (F.col("version") + 1).alias("version"), F.lit("CANDIDATE").alias("status"), F.lit('{"stage":"registered"}').alias("attributes"), "ring", F.col("p95").alias("uncertainty"))


def _bent(rings: DataFrame, weights: DataFrame, tail: list[float], origin: tuple[float, float]) -> DataFrame:
    """The rings moved by a spline about the origin, vertex by vertex."""
    ox, oy = origin
    numbered = rings.select(F.monotonically_increasing_id().alias("row"), "parcel_id", "version", F.size("ring").alias("size"), "ring")
    vertices = numbered.select("row", "parcel_id", "version", "size", F.posexplode_outer("ring").alias("at", "v"))
    vertices = cut(vertices.select("row", "parcel_id", "version", "size", "at", (F.col("v.x") - ox).alias("x"), (F.col("v.y") - oy).alias("y")))
    to = vertices.join(spline.moved(vertices, ["row", "at"], weights, tail), ["row", "at"], "left")
    corner = F.struct((F.col("to.x") + ox).alias("x"), (F.col("to.y") + oy).alias("y"))
    ring = F.transform(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", corner.alias("v"))))), lambda c: c["v"])
    return to.groupBy("row").agg(*(F.first(c).alias(c) for c in ("parcel_id", "version")), F.when(F.first("size") >= 0, ring).alias("ring")).drop("row")
