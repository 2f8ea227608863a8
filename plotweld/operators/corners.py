"""Homologous corners of two layers: vertices of rings, their angles, nearest partners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def box_ring(xmin="xmin", ymin="ymin", xmax="xmax", ymax="ymax"):
    """The ring of a box, counter-clockwise, not closed."""
    return F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in ((xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax))))


def corners(rings: DataFrame, ring: str = "ring") -> DataFrame:
    """Distinct vertices (to 4 decimals) of parcel_id and `ring`, with the inner angle in degrees.

    A shared vertex keeps the first parcel's row; null and empty rings have none; the angle
    beside an edge without length is null.
    """
    r = F.col(ring)
    last = F.get(r, F.size(r) - 1)
    open_ring = F.when((F.size(r) > 1) & (F.get(r, F.lit(0)) == last), F.slice(r, 1, F.size(r) - 1)).otherwise(r)
    rows = rings.where(F.size(ring) > 0).select("parcel_id", open_ring.alias("r"))
    rows = rows.select("parcel_id", "r", F.posexplode("r").alias("pos", "v"))
    n = F.size("r")
    before, after = F.get("r", (F.col("pos") + n - 1) % n), F.get("r", (F.col("pos") + 1) % n)
    ax, ay, bx, by = before["x"] - F.col("v.x"), before["y"] - F.col("v.y"), after["x"] - F.col("v.x"), after["y"] - F.col("v.y")
    norm = F.nullif(F.sqrt((ax * ax + ay * ay) * (bx * bx + by * by)), F.lit(0.0))
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / norm))))
    angle = F.when(norm.isNotNull(), angle)
    first = F.min(F.struct("parcel_id", "pos", F.col("v.x").alias("x"), F.col("v.y").alias("y"), angle.alias("angle")))
    # Dealt first: an aggregate of structs sorts its input, which would be a whole split of the table, with few repeats to drop.
    rows = rows.withColumns({"kx": F.round("v.x", 4), "ky": F.round("v.y", 4)}).repartition("kx", "ky")
    kept = rows.groupBy("kx", "ky").agg(first.alias("c"))
    return kept.select("c.*")


def homologous(source: DataFrame, target: DataFrame, radius: float = 50.0, max_angle: float = 30.0, keep: int = 100) -> DataFrame:
    """Corners of two layers that answer each other: nearest within `radius` once the layers' centres
    coincide, angles alike; the `keep` nearest pairs, labelled by the quadrant around the median.

    Ties go to the smaller x, then y. A small radius is tried first: where it holds `keep` pairs, all others are farther, so
    they are the answer; the search ends at `radius`. Cells of that size bound the candidates of a corner, whatever the
    layer's size; only one-row extents are broadcast.
    """
    centre = lambda d, p: d.agg(((F.min("x") + F.max("x")) / 2).alias(f"{p}x"), ((F.min("y") + F.max("y")) / 2).alias(f"{p}y"))
    shift = centre(source, "a").crossJoin(centre(target, "b")).select((F.col("bx") - F.col("ax")).alias("ox"), (F.col("by") - F.col("ay")).alias("oy"))
    shift = cut(shift)
    for share in (64, 8):
        top = cut(_nearest(source, target, shift, radius / share, max_angle, keep))
        if top.count() == keep:
            break
    else:
        top = _nearest(source, target, shift, radius, max_angle, keep)
    middle = top.agg(F.percentile("sx", 0.5).alias("x"), F.percentile("sy", 0.5).alias("y"))
    label = F.concat(F.when(F.col("sy") >= F.col("y"), "N").otherwise("S"), F.when(F.col("sx") >= F.col("x"), "E").otherwise("W"))
    return top.crossJoin(F.broadcast(middle)).select("sx", "sy", "tx", "ty", "distance", label.alias("region"))


def _nearest(source: DataFrame, target: DataFrame, shift: DataFrame, radius: float, max_angle: float, keep: int) -> DataFrame:
    """The `keep` nearest pairs of corners that are each the nearest of its source's within `radius`."""
    cell = lambda c: F.floor(F.col(c) / radius)
    s = source.select(F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("angle").alias("sa")).crossJoin(F.broadcast(shift))
    s = s.withColumns({"mx": F.col("sx") + F.col("ox"), "my": F.col("sy") + F.col("oy")})
    s = s.withColumn("cx", F.explode(F.sequence(cell("mx") - 1, cell("mx") + 1))).withColumn("cy", F.explode(F.sequence(cell("my") - 1, cell("my") + 1)))
    t = target.select(F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("angle").alias("ta"), cell("x").alias("cx"), cell("y").alias("cy"))
    dx, dy = F.col("mx") - F.col("tx"), F.col("my") - F.col("ty")
    near = s.join(t, ["cx", "cy"]).withColumn("d", F.sqrt(dx * dx + dy * dy)).where(F.col("d") <= radius)
    best = near.groupBy("sx", "sy").agg(F.min(F.struct("d", "tx", "ty", "sa", "ta")).alias("b"))
    turn = F.abs(F.coalesce("b.sa", F.lit(90.0)) - F.coalesce("b.ta", F.lit(90.0)))
    pairs = best.where(turn <= max_angle).select("sx", "sy", "b.tx", "b.ty", F.col("b.d").alias("distance"))
    return pairs.orderBy("distance", "sx", "sy").limit(keep)
