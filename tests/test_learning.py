import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotweld.operators import imagery, matcher
from plotweld.plans import learning, queries, records


def test_world_and_pixels():
    at = (500000.0, 3000200.0, 0.25)
    x, y = imagery.to_world(100, 200, *at)
    assert imagery.to_pixel(x, y, *at) == (100, 200)
    assert imagery.read_world_file("0.25\n0\n0\n-0.25\n500000\n3000200\n") == (0.25, 500000.0, 3000200.0)


def test_components_against_flooding():
    rng = np.random.default_rng(5)
    for density in (0.0, 0.4, 0.6, 1.0):
        mask = rng.random((23, 31)) < density
        seen, want = np.zeros(mask.shape, bool), set()
        for r, c in zip(*np.nonzero(mask), strict=True):
            if seen[r, c]:
                continue
            todo, part = [(r, c)], set()
            seen[r, c] = True
            while todo:
                a, b = todo.pop()
                part.add((int(a), int(b)))
                for i, j in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                    if 0 <= i < 23 and 0 <= j < 31 and mask[i, j] and not seen[i, j]:
                        seen[i, j] = True
                        todo.append((i, j))
            want.add(frozenset(part))
        assert {frozenset(zip(r.tolist(), c.tolist(), strict=True)) for r, c in imagery.components(mask)} == want


def test_masks():
    rgb = np.zeros((100, 100, 3), np.uint8)
    rgb[:] = (60, 140, 60)
    assert not imagery.building_mask(rgb).any() and not imagery.wall_mask(rgb).any()
    block, line = rgb.copy(), np.full((100, 100, 3), 150, np.uint8)
    block[30:60, 40:70] = (170, 80, 70)
    assert imagery.building_mask(block).sum() > 50
    line[50:52, 10:90] = (20, 20, 20)
    assert imagery.wall_mask(line)[48:53, 10:90].any()
    wall = imagery.render("WALL", (5.0, 5.0, 15.0, 13.0), (0.0, 20.0, 0.25), (80, 80))
    found = imagery.extract_tile("w", wall, (0.0, 20.0, 0.25))
    assert [r[2] for r in found] == ["WALL"] and abs(found[0][-1] - 10) < 0.5


def test_extract(spark):
    rgb = imagery.render("BUILDING", (5.0, 5.0, 15.0, 13.0), (0.0, 20.0, 0.25), (80, 80))
    dsm, dtm = np.full((80, 80), 9.5, np.float32).tobytes(), np.full((80, 80), 2.0, np.float32).tobytes()
    rows = [("a", 0.0, 20.0, 0.25, 80, 80, rgb.tobytes(), dsm, dtm), ("b", 0.0, 20.0, 0.25, 80, 80, None, None, None), ("c", 0.0, 20.0, 0.25, 80, 80, b"xx", None, None)]
    tiles = spark.createDataFrame(rows, "tile_id string, x0 double, y0 double, gsd double, rows int, cols int, rgb binary, dsm binary, dtm binary")
    got = imagery.extract(tiles).collect()
    assert [(r.tile_id, r.type, r.height) for r in got] == [("a", "BUILDING", 7.5)] and abs(got[0].area - 80) < 10


def test_matcher(spark):
    rows = matcher.with_part(matcher.synthetic_pairs(spark, 1500), "id").cache()
    train, rest = rows.where("part = 'train'"), rows.where("part <> 'train'")
    model = matcher.fit(train)
    scored = matcher.predict(model, rest)
    assert scored.agg(F.avg((F.col("y") == (F.col("p") >= 0.5).cast("int")).cast("int"))).first()[0] > 0.75
    weight = dict(matcher.importances(model))
    assert weight["iou"] > 0 > weight["centroid_distance"]
    for method in ("platt", "isotonic"):
        low, high = matcher.calibrate(scored, method)(scored).agg(F.min("calibrated"), F.max("calibrated")).first()
        assert 0 <= low <= high <= 1
    with pytest.raises(ValueError):
        matcher.fit(train.where("y = 1"))
    assert matcher.choose(train, "id", trees=3)[0] in ("logistic", "boosted")


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="driver tables absent")
def test_weights_of_the_decisions_are_fitted(spark):
    plan = queries.Plan(spark, "/root/testdata/sf0.01")
    weights, intercept = learning.fitted_weights(plan)
    assert {k: round(v, 2) for k, v in weights.items()} == pytest.approx(records.WEIGHTS, abs=0.03) and intercept == pytest.approx(records.INTERCEPT, abs=0.03)
    ends = learning._labelled(plan).agg(*(f(c).alias(f"{n}_{c}") for c in matcher.FEATURES for n, f in (("min", F.min), ("max", F.max)))).first()
    assert all(ends[f"min_{c}"] < ends[f"max_{c}"] for c in matcher.FEATURES)
