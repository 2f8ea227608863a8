"""Registered queries on rings; their SQL clips edges by parameters instead of cutting polygons, so the two share no method."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import rings
from ..operators import conflate, conflicts
from ..operators.spatial_join import distance_join, prefixed
from ..sources import fixtures
from .queries import Plan, query

XY = [f"{c}{v}" for v in range(4) for c in "xy"]


def ring_layer(p: Plan, name: str) -> DataFrame:
    """parcel_id, k, ring and the ring's box; dealt out, as rings cost more than the few bytes of a split tell."""
    rows = p.layer(name).repartition("parcel_id").withColumn("ring", rings.ring(*((f"x{v}", f"y{v}") for v in range(4)))).drop(*XY)
    return rows.withColumns(dict(zip(("xmin", "ymin", "xmax", "ymax"), rings.bounds(F.col("ring")), strict=True)))


def ring_pairs(p: Plan) -> DataFrame:
    return distance_join(prefixed(ring_layer(p, "source_ring"), "s_"), prefixed(ring_layer(p, "target_ring"), "t_"), "s_", "t_")


def with_ring_features(pairs: DataFrame) -> DataFrame:
    """The geometric features of pairs of convex rings."""
    s, t = F.col("s_ring"), F.col("t_ring")
    rows = pairs.withColumns({"s_area": rings.area(s), "t_area": rings.area(t), "common": rings.common_area(s, t), "s_length": rings.perimeter(s), "t_length": rings.perimeter(t)})
    (ax, ay), (bx, by) = rings.centroid(s), rings.centroid(t)
    compact = lambda a, n: 4 * F.pi() * F.col(a) / (F.col(n) * F.col(n))
    return rows.withColumns({
        "iou": g.safe_ratio(F.col("common"), F.col("s_area") + F.col("t_area") - F.col("common")), "centroid_distance": F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by)),
        "hausdorff": rings.hausdorff(s, t), "area_ratio": g.ratio_of_sizes(F.col("s_area"), F.col("t_area")), "perimeter_ratio": g.ratio_of_sizes(F.col("s_length"), F.col("t_length")),
        "shape_similarity": g.ratio_of_sizes(compact("s_area", "s_length"), compact("t_area", "t_length")), "orientation_similarity": rings.orientation_similarity(s, t),
    })


def _list(axis: str) -> str:
    return "[" + ", ".join(f"{axis}{v}" for v in range(4)) + "]"


def _ring_cte(name: str, layer: str) -> str:
    return f"{name} AS (SELECT parcel_id, {_list('x')} AS xs, {_list('y')} AS ys FROM ({fixtures.sql(layer, '//')}) q)"


_EDGE = "unnest([1, 2, 3, 4]) AS i"
RINGS = f""",
{_ring_cte("ra", "source_ring")}, {_ring_cte("rb", "target_ring")},
pa AS (SELECT a.parcel_id AS s, b.parcel_id AS t, list_transform(a.xs, lambda v: v - a.xs[1]) AS au, list_transform(a.ys, lambda v: v - a.ys[1]) AS av, list_transform(b.xs, lambda v: v - a.xs[1]) AS bu, list_transform(b.ys, lambda v: v - a.ys[1]) AS bv
  FROM ra a JOIN rb b ON list_min(a.xs) <= list_max(b.xs) AND list_max(a.xs) >= list_min(b.xs) AND list_min(a.ys) <= list_max(b.ys) AND list_max(a.ys) >= list_min(b.ys)),
ed AS (SELECT s, t, m, i, xs[i] AS px, ys[i] AS py, xs[i % 4 + 1] AS qx, ys[i % 4 + 1] AS qy, ox, oy FROM (
  SELECT s, t, 'a' AS m, au AS xs, av AS ys, bu AS ox, bv AS oy, {_EDGE} FROM pa UNION ALL SELECT s, t, 'b', bu, bv, au, av, {_EDGE} FROM pa) u),
hp AS (SELECT *, (ox[j % 4 + 1] - ox[j]) * (py - oy[j]) - (oy[j % 4 + 1] - oy[j]) * (px - ox[j]) AS f, (ox[j % 4 + 1] - ox[j]) * (qy - oy[j]) - (oy[j % 4 + 1] - oy[j]) * (qx - ox[j]) AS g FROM (SELECT *, unnest([1, 2, 3, 4]) AS j FROM ed) v),
iv AS (SELECT s, t, m, i, px, py, qx, qy, bool_or(f < 0 AND g < 0) AS out, max(CASE WHEN f < 0 AND g >= 0 THEN f / (f - g) ELSE 0 END) AS lo, min(CASE WHEN f >= 0 AND g < 0 THEN f / (f - g) ELSE 1 END) AS hi FROM hp GROUP BY ALL),
cm AS (SELECT s, t, greatest(0, COALESCE(sum((px + lo * (qx - px)) * (py + hi * (qy - py)) - (px + hi * (qx - px)) * (py + lo * (qy - py))) FILTER (WHERE NOT out AND lo < hi), 0) / 2) AS common FROM iv GROUP BY 1, 2),
ms AS (SELECT s, t, m, abs(sum(px * qy - qx * py)) / 2 AS area, sum(sqrt((qx - px) ** 2 + (qy - py) ** 2)) AS len, sum((px + qx) * (px * qy - qx * py)) / (3 * sum(px * qy - qx * py)) AS cx, sum((py + qy) * (px * qy - qx * py)) / (3 * sum(px * qy - qx * py)) AS cy FROM ed GROUP BY 1, 2, 3),
pd AS (SELECT s, t, m, i, min(sqrt((px - ox[j] - w * (ox[j % 4 + 1] - ox[j])) ** 2 + (py - oy[j] - w * (oy[j % 4 + 1] - oy[j])) ** 2)) AS d FROM (
  SELECT *, greatest(0, least(1, ((px - ox[j]) * (ox[j % 4 + 1] - ox[j]) + (py - oy[j]) * (oy[j % 4 + 1] - oy[j])) / ((ox[j % 4 + 1] - ox[j]) ** 2 + (oy[j % 4 + 1] - oy[j]) ** 2))) AS w FROM hp) z GROUP BY 1, 2, 3, 4),
hd AS (SELECT s, t, max(d) AS h FROM pd GROUP BY 1, 2)"""
_A, _B = "x.area", "y.area"


@query("""SELECT x.s AS source_id, x.t AS target_id, round(common / (x.area + y.area - common), 6) AS iou, round(sqrt((x.cx - y.cx) ** 2 + (x.cy - y.cy) ** 2), 6) AS centroid_distance, round(h, 6) AS hausdorff,
  round(least(x.area, y.area) / greatest(x.area, y.area), 6) AS area_ratio, round(least(x.len, y.len) / greatest(x.len, y.len), 6) AS perimeter_ratio,
  round(least(x.area / x.len ** 2, y.area / y.len ** 2) / greatest(x.area / x.len ** 2, y.area / y.len ** 2), 6) AS shape_similarity
  FROM ms x JOIN ms y ON x.s = y.s AND x.t = y.t AND x.m = 'a' AND y.m = 'b' JOIN cm ON cm.s = x.s AND cm.t = x.t JOIN hd ON hd.s = x.s AND hd.t = x.t""", RINGS)
def pair_features_ring(p: Plan) -> DataFrame:
    """Features of parcels of any convex shape."""
    names = ("iou", "centroid_distance", "hausdorff", "area_ratio", "perimeter_ratio", "shape_similarity")
    return with_ring_features(ring_pairs(p)).select(F.col("s_parcel_id").alias("source_id"), F.col("t_parcel_id").alias("target_id"), *(F.round(n, 6).alias(n) for n in names))


@query("SELECT source_id, target_id, round(iou, 6) AS iou FROM (SELECT cm.s AS source_id, cm.t AS target_id, common / (x.area + y.area - common) AS iou, row_number() OVER (PARTITION BY cm.s ORDER BY common / (x.area + y.area - common) DESC, cm.t) AS n FROM cm JOIN ms x ON x.s = cm.s AND x.t = cm.t AND x.m = 'a' JOIN ms y ON y.s = cm.s AND y.t = cm.t AND y.m = 'b') WHERE n = 1", RINGS)
def best_match_ring(p: Plan) -> DataFrame:
    rows = ring_pairs(p).withColumns({"s_area": rings.area(F.col("s_ring")), "t_area": rings.area(F.col("t_ring")), "common": rings.common_area(F.col("s_ring"), F.col("t_ring"))})
    share = g.safe_ratio(F.col("common"), F.col("s_area") + F.col("t_area") - F.col("common"))
    best = rows.select("s_parcel_id", "t_parcel_id", share.alias("iou")).groupBy("s_parcel_id").agg(F.min(F.struct((-F.col("iou")).alias("o"), F.col("t_parcel_id").alias("t"))).alias("b"))
    return best.select(F.col("s_parcel_id").alias("source_id"), F.col("b.t").alias("target_id"), F.round(-F.col("b.o"), 6).alias("iou"))


_TURN = """(SELECT parcel_id, arg_min(atan2(dy, dx), {{'a': round(size, 4), 'i': i}}) AS angle FROM (
  SELECT parcel_id, i, dx, dy, (list_max(list_transform([1, 2, 3, 4], lambda k: (xs[k] - xs[1]) * dx + (ys[k] - ys[1]) * dy)) - list_min(list_transform([1, 2, 3, 4], lambda k: (xs[k] - xs[1]) * dx + (ys[k] - ys[1]) * dy)))
    * (list_max(list_transform([1, 2, 3, 4], lambda k: (ys[k] - ys[1]) * dx - (xs[k] - xs[1]) * dy)) - list_min(list_transform([1, 2, 3, 4], lambda k: (ys[k] - ys[1]) * dx - (xs[k] - xs[1]) * dy))) / (dx * dx + dy * dy) AS size
  FROM (SELECT *, xs[i % 4 + 1] - xs[i] AS dx, ys[i % 4 + 1] - ys[i] AS dy FROM (SELECT *, unnest([1, 2, 3, 4]) AS i FROM {0}) q) r) w GROUP BY 1)"""


@query(f"SELECT a.parcel_id AS source_id, b.parcel_id AS target_id, round(1 - least(abs(a.angle - b.angle), pi() - abs(a.angle - b.angle)) / (pi() / 2), 5) AS orientation_similarity FROM {_TURN.format('ra')} a JOIN {_TURN.format('rb')} b ON substr(a.parcel_id, 3) = substr(b.parcel_id, 3)", RINGS)
def orientation_ring(p: Plan) -> DataFrame:
    """Of every parcel and its namesake."""
    a, b = ring_layer(p, "source_ring"), ring_layer(p, "target_ring")
    both = a.select("k", F.col("parcel_id").alias("source_id"), F.col("ring").alias("a")).join(b.select("k", F.col("parcel_id").alias("target_id"), F.col("ring").alias("b")), "k")
    return both.select("source_id", "target_id", F.round(rings.orientation_similarity(F.col("a"), F.col("b")), 5).alias("orientation_similarity"))


@query(f"""SELECT parcel_id, round(abs(sum(x * ny - nx * y)) / 2, 6) AS area, round(sum(sqrt((nx - x) ** 2 + (ny - y) ** 2)), 6) AS perimeter, min(ox) AS xmin, min(oy) AS ymin, max(ox) AS xmax, max(oy) AS ymax, 4 AS vertices, CAST(NULL AS VARCHAR) AS invalid
  FROM (SELECT parcel_id, xs[i] AS ox, ys[i] AS oy, xs[i] - xs[1] AS x, ys[i] - ys[1] AS y, xs[i % 4 + 1] - xs[1] AS nx, ys[i % 4 + 1] - ys[1] AS ny FROM (SELECT *, {_EDGE} FROM ra) q) r GROUP BY 1""", RINGS)
def geometry_metadata(p: Plan) -> DataFrame:
    """Area, perimeter, bounds, size and validity of every ring of a layer."""
    r = F.col("ring")
    return ring_layer(p, "source_ring").select("parcel_id", F.round(rings.area(r), 6).alias("area"), F.round(rings.perimeter(r), 6).alias("perimeter"), "xmin", "ymin", "xmax", "ymax", F.size(r).alias("vertices"), rings.validity(r).alias("invalid"))


TWINS = f""",
hs AS ({fixtures.sql("half_parcel", "//")}), jt AS ({fixtures.sql("joint_parcel", "//")})"""


@query("""SELECT t.parcel_id AS target_id, string_agg(s.parcel_id, ',' ORDER BY s.parcel_id) AS sources, 'MERGE' AS relation, 0.85::DOUBLE AS probability FROM hs s JOIN jt t ON t.k = s.k // 2 GROUP BY 1
  HAVING count(*) >= 2 AND min((least(s.xmax, t.xmax) - greatest(s.xmin, t.xmin)) * 30 / 600) >= 0.5 AND sum((least(s.xmax, t.xmax) - greatest(s.xmin, t.xmin)) * 30) / 1200 >= 0.85""", TWINS)
def merge_twins(p: Plan) -> DataFrame:
    """Halves that one target joins: decided by the rules, then found as merges."""
    s, t = p.layer("half_parcel"), p.layer("joint_parcel")
    scored = conflate.rule_probability(conflate.with_features(conflate.candidates(s, t)))
    scored = scored.withColumns({f"e_{d}": F.lit(0.5) for d in conflate.WEIGHTS})
    return conflate.merges(conflate.decide(s, scored), s, t).select("target_id", F.array_join("sources", ",").alias("sources"), "relation", "probability")


@query("""SELECT s.parcel_id AS source_id, t.parcel_id AS target_id, 'ONE_TO_ONE' AS relation, 0.625::DOUBLE AS probability, NULL AS merged_sources FROM hs s JOIN jt t ON t.k = s.k // 2
  UNION ALL SELECT min(s.parcel_id), t.parcel_id, 'MERGE', 0.85::DOUBLE, string_agg(s.parcel_id, ',' ORDER BY s.parcel_id) FROM hs s JOIN jt t ON t.k = s.k // 2 GROUP BY t.parcel_id HAVING count(*) = 2""", TWINS)
def decisions_with_merges(p: Plan) -> DataFrame:
    s, t = p.layer("half_parcel"), p.layer("joint_parcel")
    scored = conflate.rule_probability(conflate.with_features(conflate.candidates(s, t)))
    decided = conflate.decide(s, scored.withColumns({f"e_{d}": F.lit(0.5) for d in conflate.WEIGHTS}))
    return conflate.with_merges(decided, conflate.merges(decided, s, t)).select("source_id", F.get("targets", F.lit(0)).alias("target_id"), "relation", "probability", F.array_join("merged_sources", ",").alias("merged_sources"))


CROWD = f""",
cr AS ({fixtures.sql("crowded_parcel", "//")})"""


@query("""SELECT a, b, (x1 - x0) * (y1 - y0) AS common, x0 AS xmin, y0 AS ymin, x1 AS xmax, y1 AS ymax FROM (SELECT a.parcel_id AS a, b.parcel_id AS b, greatest(a.xmin, b.xmin) AS x0, greatest(a.ymin, b.ymin) AS y0, least(a.xmax, b.xmax) AS x1, least(a.ymax, b.ymax) AS y1 FROM cr a JOIN cr b ON a.parcel_id < b.parcel_id AND a.xmin < b.xmax AND b.xmin < a.xmax AND a.ymin < b.ymax AND b.ymin < a.ymax) WHERE (x1 - x0) * (y1 - y0) / 1200 >= 0.05""", CROWD)
def overlap_geometries(p: Plan) -> DataFrame:
    """Overlaps of one layer with their common box."""
    found = conflicts.overlaps(p.layer("crowded_parcel"))
    i = g.intersection(g.box("a_"), g.box("b_"))
    return found.select(F.col("a_parcel_id").alias("a"), F.col("b_parcel_id").alias("b"), "common", *(c.alias(n) for c, n in zip(i, ("xmin", "ymin", "xmax", "ymax"), strict=True)))
