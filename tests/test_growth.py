"""What a costly step is given: tests of plans and of small cases, so that work and memory grow with the input alone."""

import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotweld.functions import rings
from plotweld.operators import conflate, corners, escalation, imagery, matcher
from plotweld.operators.spatial_join import distance_join


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _quads(spark, n):
    x, y = F.col("id") % 100 * 50.0, F.floor(F.col("id") / 100) * 40.0
    return spark.range(n).select("id", rings.ring((x, y), (x + 40, y + 1), (x + 41, y + 30), (x + 1, y + 31)).alias("ring"))


@pytest.mark.parametrize("name", ["inset", "turn"])
def test_ring_measures_are_computed_once(spark, name):
    """Before, insets took some 7 ms a ring."""
    value = {"inset": lambda r: F.size(rings.inset(r, F.lit(4.0))), "turn": rings.turn}[name](F.col("ring"))
    rows = _quads(spark, 6000).repartition(4).select(value.alias("v"))
    rows.limit(1).collect()
    start = time.monotonic()
    assert rows.where("v is not null").count() == 6000
    assert time.monotonic() - start < 5


def test_ring_tests_stand_behind_the_join_on_boxes(spark):
    box = [c.alias(n) for n, c in zip(("xmin", "ymin", "xmax", "ymax"), rings.bounds(F.col("ring")), strict=True)]
    layer = _quads(spark, 20).select(F.col("id").cast("string").alias("parcel_id"), "ring", *box)
    built = layer.select(F.col("parcel_id").alias("obs_id"), F.lit("WALL").alias("type"), "ring", "xmin", "ymin", "xmax", "ymax")
    found = conflate.building_support_ring(layer, built)
    joins = [line for line in _plan(found).splitlines() if "Join Inner" in line]
    assert joins and not any("exists(" in line for line in joins)
    assert {r.t_parcel_id: r.n_buildings for r in found.collect()} == {str(k): 1 for k in range(20)}


def test_samples_are_the_smallest_checksums_whatever_bounds_them(spark, monkeypatch):
    points = spark.range(200).select(F.col("id").alias("point_id"), (F.col("id") % 17 * 3.0).alias("sx"), (F.col("id") % 23 * 2.0).alias("sy")).withColumns({"tx": F.col("sx") + 1, "ty": F.col("sy") - F.col("point_id") % 5})
    read = lambda: {r.iteration: r.m for r in escalation.sample_models(points, 20).collect()}
    whole = read()
    monkeypatch.setattr(escalation, "BOUNDING", 7)
    assert read() == whole and set(whole) == set(range(1, 21))
    assert "checksum" in _plan(escalation.sample_models(points, 20))
    assert escalation.sample_models(points.limit(2), 20).count() == 0


def test_near_corners_answer_before_the_whole_radius(spark, monkeypatch):
    at = spark.range(300).select((F.col("id") % 20 * 60.0).alias("x"), (F.floor(F.col("id") / 20) * 60.0).alias("y"), F.lit(90.0).alias("angle"))
    off = at.withColumn("x", F.col("x") + F.when((F.col("x") > 0) & (F.col("x") < 1140), F.col("y") / 9000).otherwise(0.0))
    radii, near = [], corners._nearest
    monkeypatch.setattr(corners, "_nearest", lambda s, t, o, radius, *rest: radii.append(radius) or near(s, t, o, radius, *rest))
    found = sorted(map(tuple, corners.homologous(at, off).collect()))
    assert len(found) == 100 and radii == [50 / 64]
    few = corners.homologous(at.limit(30), off.limit(30))
    assert few.count() == 30 and radii[-1] == 50


def test_vertices_are_dealt_out_before_they_are_sorted(spark):
    rows = _quads(spark, 30).select(F.col("id").cast("string").alias("parcel_id"), "ring")
    assert "RepartitionByExpression" in _plan(corners.corners(rows)) and corners.corners(rows).count() == 120


def test_building_mask_of_the_part_that_is_not_green():
    """As over the whole tile, also for buildings at its edge."""
    for seed in range(6):
        r = np.random.default_rng(seed)
        rgb = imagery.render("ROAD_EDGE", (0, 0, 1, 1), (0, 20, 0.25), (80, 90), seed).copy()
        top, left = r.integers(0, 60), r.integers(0, 60)
        rgb[top : top + 20, left : left + 30] = (170, 80, 70)
        rgb[:12, :14] = (170, 80, 70)
        rgb[r.integers(0, 80, 40), r.integers(0, 90, 40)] = (120, 90, 70)
        whole = imagery._buildings(rgb)
        assert whole.any() and (imagery.building_mask(rgb) == whole).all()
    assert not imagery.building_mask(imagery.render("FENCE", (0, 0, 1, 1), (0, 20, 0.25), (80, 90))).any()


def test_tiles_are_dealt_out(spark):
    boxes = spark.createDataFrame([("a", "BUILDING", 0.0, 0.0, 8.0, 8.0)], "obs_id string, type string, xmin double, ymin double, xmax double, ymax double")
    assert "RepartitionByExpression" in _plan(imagery.extract_rendered(boxes)) and imagery.extract_rendered(boxes).count() == 1


def test_the_matcher_reads_its_rows_instead_of_joining_again(spark):
    from plotweld.plans.queries import QUERIES

    import plotweld.plans.learning  # noqa: F401

    assert "Join" not in _plan(QUERIES["matcher_scores"](spark, "/root/testdata/sf0.001"))


def test_cross_validation_reads_few_partitions_and_joins_nothing_again(spark, monkeypatch):
    from plotweld.plans import learning  # noqa: F401
    from plotweld.plans.queries import QUERIES

    seen = []
    monkeypatch.setattr(matcher, "cross_validate", lambda rows, key: seen.append((_plan(rows), rows.rdd.getNumPartitions(), rows.count())) or [0.5] * 5)
    assert QUERIES["matcher_cross_validation"](spark, "/root/testdata/sf0.001").count() == 5
    [(plan, partitions, n)] = seen
    assert "Join" not in plan and n > 0 and partitions < int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_distance_join_deals_both_layers_to_their_cells(spark):
    """Before, a layer with a small file was broadcast, and one task made all pairs."""
    side = lambda prefix: spark.range(50).select(*((F.col("id") * 20.0 + d).alias(prefix + n) for n, d in (("xmin", 0.0), ("ymin", 0.0), ("xmax", 9.0), ("ymax", 9.0))), F.col("id").alias(prefix + "id"))
    found = distance_join(side("a_"), side("b_"), "a_", "b_", 16.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted((r.a_id, r.b_id) for r in found.collect()) == [(i, j) for i in range(50) for j in range(50) if abs(i - j) <= 1]


def test_folds_are_fitted_side_by_side(spark):
    rows = matcher.synthetic_pairs(spark, 600).persist()
    meet = threading.Barrier(5, timeout=60)
    losses = matcher.cross_validate(rows, "id", fitter=lambda d: meet.wait() >= 0 and matcher.fit(d))
    fold = F.pmod(F.xxhash64(F.col("id"), F.col("y")), F.lit(5))
    assert losses == pytest.approx([matcher.log_loss(matcher.predict(matcher.fit(rows.where(fold != k)), rows.where(fold == k))) for k in range(5)], rel=1e-6)
    rows.unpersist()
