"""Registered queries of the fitted matcher, its calibration, and observations from imagery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import rings
from ..operators import conflate, imagery, matcher
from ..operators.lineage import cut
from .polygons import ring_layer
from .queries import Plan, query


def _labelled(p: Plan) -> DataFrame:
    """Candidate pairs with all features; a pair of the same parcel number is a match. The turn of a parcel is that of its surveyed ring."""
    turn = lambda layer, k, name: ring_layer(p, layer).select(F.col("k").alias(k), rings.turn(F.col("ring")).alias(name))
    rows = p.evidence().join(turn("source_ring", "s_k", "s_turn"), "s_k", "left").join(turn("target_ring", "t_k", "t_turn"), "t_k", "left")
    s, t = g.box("s_"), g.box("t_")
    named = {
        "boundary_distance": F.col("hausdorff"), "intersection_area": g.intersection_area(s, t), "orientation_similarity": rings.turns_alike(F.col("s_turn"), F.col("t_turn")),
        "gnss_support": F.col("e_survey"), "building_support": F.col("e_physical"), "y": (F.col("s_k") == F.col("t_k")).cast("int"),
    }
    return matcher.with_part(rows.withColumns(named), "s_parcel_id").select("s_parcel_id", "t_parcel_id", *matcher.FEATURES, "y", "part")


def _fitted(p: Plan):
    """The rows, written out as each later step reads them again, and the model of the training part."""
    rows = cut(_labelled(p))
    train = rows.where("part = 'train'").persist()
    try:
        return rows, matcher.fit(train)
    finally:
        train.unpersist()


def fitted_weights(p: Plan) -> tuple[dict[str, float], float]:
    """Weights and intercept, on the plain features, of a regression on the pairs' own features, fitted on the training part."""
    own = ("iou", "centroid_distance", "area_ratio", "perimeter_ratio", "shape_similarity", "attribute_similarity")
    train = _labelled(p).where("part = 'train'").withColumns({f: F.lit(0.0) for f in matcher.FEATURES if f not in own}).persist()
    try:
        return matcher.plain_weights(matcher.fit(train), own)
    finally:
        train.unpersist()


@query(None)
def matcher_scores(p: Plan) -> DataFrame:
    rows, model = _fitted(p)
    return matcher.predict(model, rows).select("s_parcel_id", "t_parcel_id", "part", "y", "p")


@query(None)
def matcher_importances(p: Plan) -> DataFrame:
    _, model = _fitted(p)
    return p.spark.createDataFrame(matcher.importances(model), "feature string, weight double")


@query(None)
def calibrated_scores(p: Plan) -> DataFrame:
    """The test part, calibrated on a part that neither trains nor tests."""
    rows, model = _fitted(p)
    scored = matcher.predict(model, rows)
    known = scored.where("part = 'calibrate'")
    test = matcher.calibrate(known, "platt")(scored.where("part = 'test'")).withColumnRenamed("calibrated", "platt")
    return matcher.calibrate(known, "isotonic")(test).select("s_parcel_id", "t_parcel_id", "y", "p", "platt", F.col("calibrated").alias("isotonic"))


@query(None)
def matcher_cross_validation(p: Plan) -> DataFrame:
    """Log loss of five folds over all candidate pairs, written out first: in as many partitions as their bytes ask for, not one for each of the joins' tasks."""
    rows = cut(_labelled(p).select("s_parcel_id", *matcher.FEATURES, "y")).persist()
    try:
        losses = matcher.cross_validate(rows, "s_parcel_id")
    finally:
        rows.unpersist()
    return p.spark.createDataFrame(list(enumerate(losses)), "fold int, log_loss double")


@query(None)
def imagery_observations(p: Plan) -> DataFrame:
    """Buildings and walls found on tiles drawn of the observations."""
    return imagery.extract_rendered(p.layer("observation"))


def _made(layer: str) -> str:
    kept = " UNION ALL ".join(
        f"SELECT concat(parcel_id, '-W{n}') AS obs_id, 'WALL' AS type, {x0} AS x0, {y0} AS y0, {x1} AS x1, {y1} AS y1 FROM big WHERE (k * 7919 + {n} * 1049) % 100 < 60 AND {long} >= 2"
        for n, (x0, y0, x1, y1, long) in enumerate((("xmin", "ymin", "xmax", "ymin", "xmax - xmin"), ("xmax", "ymin", "xmax", "ymax", "ymax - ymin"), ("xmin", "ymax", "xmax", "ymax", "xmax - xmin"), ("xmin", "ymin", "xmin", "ymax", "ymax - ymin")))
    )
    u = lambda salt: f"((k * 7919 + {salt}) % 17 / 16e0)"
    inner = "obs_id, type, ix + (iw / 4) * {0} AS x0, iy + (ih / 4) * {1} AS y0, ix + iw - (iw / 4) * {2} AS x1, iy + ih - (ih / 4) * {3} AS y1".format(u(3), u(5), u(7), u(11))
    return f"""big AS (SELECT * FROM {layer} WHERE (xmax - xmin) * (ymax - ymin) >= 100),
inside AS (SELECT concat(parcel_id, '-B') AS obs_id, 'BUILDING' AS type, k, xmin + 3 AS ix, ymin + 3 AS iy, xmax - xmin - 6 AS iw, ymax - ymin - 6 AS ih FROM big)
SELECT {inner} FROM inside WHERE iw > 0 AND ih > 0 UNION ALL {kept}"""


@query("SELECT * FROM made", f",\nmade AS (WITH {_made('tgt')})")
def synthetic_observations(p: Plan) -> DataFrame:
    """Stand-ins where no imagery is at hand: a building inside every parcel of 100 square metres or more, walls on most edges."""
    return p.spark.sql("WITH " + _made("{tgt}"), tgt=p.layer("target_parcel"))
