"""Registered queries of the evidence stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rings
from ..operators import corners, observing
from ..sources import fixtures
from .queries import Plan, query


def _noise(key: str, span: tuple[float, float] = (0.0, 1.0)) -> str:
    return f"({span[0]!r}::DOUBLE + {span[1] - span[0]!r}::DOUBLE * (('0x' || substr(md5({key}), 1, 6))::BIGINT::DOUBLE / 16777216))"


def _figure(what: str, spans: dict[str, tuple[float, float]]) -> str:
    return f"floor(CASE WHEN type = 'BUILDING' THEN {_noise(f'obs_id || {what!r}', spans['BUILDING'])} ELSE {_noise(f'obs_id || {what!r}', spans['WALL'])} END * 1000) / 1000"


# On boxes insets, clipping and areas have closed forms; each wall is an edge by itself.
WALLS = " UNION ALL ".join(
    f"SELECT dataset_id, with_height, parcel_id, key || '/W{j}' AS obs_id, 'WALL' AS type, {x0} AS bx0, {y0} AS by0, {x1} AS bx1, {y1} AS by1, 0 AS area FROM room WHERE {long} >= 2 AND {_noise(f'key || {chr(39)}/W{j}/is{chr(39)}')} < 0.6::DOUBLE"
    for j, (x0, y0, x1, y1, long) in enumerate((("xmin", "ymin", "xmax", "ymin", "xmax - xmin"), ("xmax", "ymin", "xmax", "ymax", "ymax - ymin"), ("xmin", "ymax", "xmax", "ymax", "xmax - xmin"), ("xmin", "ymin", "xmin", "ymax", "ymax - ymin")))
)
STAGE = f""",
req AS ({fixtures.sql("evidence_request", "//")}), ast AS ({fixtures.sql("evidence_asset", "//")}), ext AS ({fixtures.sql("extracted_feature", "//")}), plog AS ({fixtures.sql("parcel_box_version", "//")}),
ori AS (SELECT dataset_id, arg_min(asset_id, row_id) AS asset_id FROM ast WHERE type = 'ORI' GROUP BY 1),
seen AS (SELECT r.dataset_id, r.with_height, e.* FROM req r JOIN ori USING (dataset_id) JOIN ext e ON e.asset_id = ori.asset_id),
newest AS (SELECT * FROM plog p WHERE version = (SELECT max(version) FROM plog q WHERE q.parcel_id = p.parcel_id)),
room0 AS (SELECT r.dataset_id, r.with_height, n.parcel_id, r.dataset_id || '/' || n.parcel_id AS key, n.xmin, n.ymin, n.xmax, n.ymax, n.xmax - n.xmin - 6 AS iw, n.ymax - n.ymin - 6 AS ih FROM req r JOIN newest n ON n.xmin <= r.xmax AND n.xmax >= r.xmin AND n.ymin <= r.ymax AND n.ymax >= r.ymin
  WHERE r.dataset_id NOT IN (SELECT dataset_id FROM seen) AND (n.xmax - n.xmin) * (n.ymax - n.ymin) >= 100),
room AS (SELECT *, iw * {_noise("key || '/w'", observing.SIDE)} AS w, ih * {_noise("key || '/h'", observing.SIDE)} AS h FROM room0 WHERE iw > 0 AND ih > 0 AND iw * ih >= 10 AND iw * {_noise("key || '/w'", observing.SIDE)} * ih * {_noise("key || '/h'", observing.SIDE)} >= 5),
made AS (SELECT dataset_id, with_height, parcel_id, key || '/B' AS obs_id, 'BUILDING' AS type, xmin + 3 + (iw - w) * {_noise("key || '/x'", observing.PLACE)} AS bx0, ymin + 3 + (ih - h) * {_noise("key || '/y'", observing.PLACE)} AS by0, bx0 + w AS bx1, by0 + h AS by1, w * h AS area FROM room
  UNION ALL {WALLS}),
stage AS (
  SELECT obs_id, dataset_id, type, 'image-extraction-v2' AS model, confidence, uncertainty, CASE WHEN with_height THEN height END AS height, NULL::VARCHAR AS parcel_id, x AS x0, y AS y0, x + side AS x1, y + side AS y1, side * side AS area FROM seen UNION ALL
  SELECT obs_id, dataset_id, type, 'synthetic-v1', {_figure("/c", observing.CONFIDENCE)}, {_figure("/u", observing.UNCERTAINTY)}, CASE WHEN with_height AND type = 'BUILDING' THEN floor({_noise("obs_id || '/h'", observing.HEIGHT)} * 10) / 10 END, parcel_id, bx0, by0, bx1, by1, area FROM made)"""


def _stage(p: Plan) -> DataFrame:
    ring = corners.box_ring
    extracted = p.layer("extracted_feature").withColumn("ring", rings.ring(("x", "y"), (F.col("x") + F.col("side"), "y"), (F.col("x") + F.col("side"), F.col("y") + F.col("side")), ("x", F.col("y") + F.col("side"))))
    return observing.evidence_stage(p.layer("evidence_request"), p.layer("evidence_asset"), extracted, p.layer("parcel_box_version").withColumn("ring", ring()))


@query("SELECT obs_id, dataset_id, type, model, confidence, uncertainty, height, parcel_id, round(x0, 3) AS xmin, round(y0, 3) AS ymin, round(x1, 3) AS xmax, round(y1, 3) AS ymax, round(area, 3) AS area FROM stage", STAGE)
def evidence_stage(p: Plan) -> DataFrame:
    """Observations of every dataset: from its first image where that showed something, otherwise stand-ins from the parcels."""
    x0, y0, x1, y1 = rings.bounds(F.col("ring"))
    return _stage(p).withColumns({n: F.round(c, 3) for n, c in (("xmin", x0), ("ymin", y0), ("xmax", x1), ("ymax", y1), ("area", rings.area(F.col("ring"))))}).drop("ring")


@query("SELECT dataset_id, model, count(*) AS n, count(*) FILTER (type = 'BUILDING') AS buildings, count(DISTINCT parcel_id) AS parcels FROM stage GROUP BY ALL", STAGE)
def evidence_by_dataset(p: Plan) -> DataFrame:
    """What the stage gave each dataset, and by which way."""
    return _stage(p).groupBy("dataset_id", "model").agg(F.count("*").alias("n"), F.count(F.when(F.col("type") == "BUILDING", 1)).alias("buildings"), F.count_distinct("parcel_id").alias("parcels"))
