"""Registration by escalation against numpy, by the rule of the worst region."""

import numpy as np
import pytest

from plotweld.operators import escalation, registration, spline

POINTS = "point_id int, sx double, sy double, tx double, ty double"


def frame(spark, src, dst):
    return spark.createDataFrame([(i, *map(float, (*a, *b))) for i, (a, b) in enumerate(zip(src, dst, strict=True))], POINTS)


def labels(src):
    lo, span = src.min(0), np.maximum(np.ptp(src, axis=0), 1e-9)
    return np.minimum(((src - lo) / span * 3).astype(int), 2) @ [1, 3]


def by_hand(src, dst, envelope=0.5):
    """(method, P95 of the worst region, accepted) of the steps tried."""
    if len(src) < 3:
        return []
    ones, where, log = np.c_[src, np.ones(len(src))], labels(src), []
    m = registration.helmert_fit(src, dst)
    for name, factor, predict in (("helmert", 1.5, lambda: src @ m[:2, :2].T + m[:2, 2]), ("affine", 1.5, lambda: ones @ np.linalg.lstsq(ones, dst, rcond=None)[0]), ("tps", 2.0, lambda: registration.spline(src, dst)(src))):
        r = np.linalg.norm(predict() - dst, axis=1)
        worst = max(np.percentile(r[where == w], 95) for w in set(where.tolist()))
        log.append((name, worst, worst <= factor * envelope))
        if log[-1][2]:
            break
    return log


def cases():
    rng = np.random.default_rng(8)
    src = rng.uniform(0, 300, (90, 2))
    noise = rng.uniform(-0.1, 0.1, src.shape)
    shear = np.c_[src[:, 0] + 0.05 * src[:, 1], src[:, 1]]
    wave = np.c_[src[:, 0] + 3 * np.sin(src[:, 1] / 60), src[:, 1]]
    bad = src + noise
    bad[np.argsort(src.sum(1))[:4]] += 3.0  # under a twentieth of the points, all in one region
    return {"moved": (src, src + [2, -1] + noise), "shear": (src, shear + noise), "wave": (src, wave), "bad": (src, bad), "broken": (src, src + rng.uniform(-9, 9, src.shape)), "few": (src[:2], src[:2])}


@pytest.mark.parametrize("name", ["moved", "shear", "wave", "bad", "few"])
def test_steps_by_hand(spark, name):
    src, dst = cases()[name]
    got = escalation.escalated(frame(spark, src, dst)).orderBy("step").collect()
    want = by_hand(src, dst)
    assert [(r.method, r.accepted) for r in got] == [(m, a) for m, _, a in want]
    assert np.allclose([r.worst_p95 for r in got], [w for _, w, _ in want], atol=1e-6)
    assert [r.chosen for r in got] == [i + 1 == len(want) for i in range(len(want))]


def test_one_bad_region_fails_maps_that_are_good_overall(spark):
    src, dst = cases()["bad"]
    steps = {r.method: r for r in escalation.escalated(frame(spark, src, dst)).collect()}
    assert steps["helmert"].p95 < 0.75 < steps["helmert"].worst_p95 and not steps["helmert"].accepted and not steps["affine"].accepted


def test_run_record(spark):
    src, dst = cases()["shear"]
    row = escalation.run_record(frame(spark, src, dst)).first()
    assert (row.method, row.passed, row.conflict_type) == ("affine", True, None) and abs(row.worst_p95 - by_hand(src, dst)[-1][1]) < 1e-9
    none = escalation.run_record(frame(spark, src[:2], dst[:2])).first()
    assert (none.method, none.n, none.passed, none.conflict_type) == ("none", 0, False, "REGISTRATION_FAILURE")


def test_ransac(spark):
    rng = np.random.default_rng(1)
    src = rng.uniform(0, 100, (40, 2))
    dst = src + [2, -1] + rng.uniform(-0.2, 0.2, src.shape)
    dst[:12] += rng.uniform(15, 60, (12, 2))
    got = {r.point_id: r.inlier for r in escalation.ransac(frame(spark, src, dst)).collect()}
    assert got == {i: i >= 12 for i in range(40)}
    assert escalation.ransac(frame(spark, src[:2], dst[:2])).count() == 0
    model = escalation.sample_models(frame(spark, src[:3], dst[:3]), 1).first().m
    assert np.allclose([[model.a, model.b, model.e], [model.c, model.d, model.f]], registration.helmert_fit(src[:3], dst[:3])[:2])


def test_layer_by_the_spline(spark):
    src, dst = cases()["wave"]
    rng = np.random.default_rng(4)
    rings = rng.uniform(0, 300, (25, 5, 2))
    layer = spark.createDataFrame([(f"p{i}", i, [tuple(map(float, v + [1000, 2000])) for v in r]) for i, r in enumerate(rings)], "parcel_id string, version int, ring array<struct<x: double, y: double>>")
    rows = escalation.registered(layer, escalation.escalated(frame(spark, src, dst)), (1000.0, 2000.0)).collect()
    want = registration.spline(src, dst)
    assert len(rows) == 25
    for r in rows:
        i = int(r.parcel_id[1:])
        assert r.version == i + 1 and np.abs(np.array([(v.x, v.y) for v in r.ring]) - [1000, 2000] - want(rings[i])).max() < 1e-6


def test_shared_edges_stay_shared(spark):
    src, dst = cases()["shear"]
    left, right = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], [(10.0, 0.0), (20.0, 0.0), (20.0, 10.0), (10.0, 10.0)]
    layer = spark.createDataFrame([("a", 1, left), ("b", 3, right)], "parcel_id string, version int, ring array<struct<x: double, y: double>>")
    rows = {r.parcel_id: r for r in escalation.registered(layer, escalation.escalated(frame(spark, src, dst)), (0.0, 0.0)).collect()}
    assert rows["a"].ring[1] == rows["b"].ring[0] and rows["a"].ring[2] == rows["b"].ring[3]
    assert (rows["a"].version, rows["b"].version, rows["b"].status) == (2, 4, "CANDIDATE")
    assert escalation.registered(layer, escalation.escalated(frame(spark, src[:2], dst[:2])), (0.0, 0.0)).count() == 0


def test_sketch_keeps_its_bound(spark):
    values = np.random.default_rng(6).gamma(2.0, 1.0, 20_000)
    rows = spark.createDataFrame([("a" if i % 2 else "b", float(v)) for i, v in enumerate(values)], "region string, residual double")
    for r in registration.regional_sketch(rows, 100).collect():
        own = np.sort(values[1::2] if r.region == "a" else values[::2])
        for q, v in ((0.5, r.p50), (0.95, r.p95)):
            assert abs(np.searchsorted(own, v) - q * len(own)) <= len(own) / 100 + 1


def test_residuals_of_the_kernels():
    square = np.array([[0, 0], [10, 0], [10, 10], [0, 10]], float)
    f = registration.spline(square, square + [2, -1])
    assert np.abs(f(square) - square - [2, -1]).max() < 1e-6


def test_spline_takes_all_points(spark):
    """Before, a spline was fitted to 100 of them at most."""
    rng = np.random.default_rng(3)
    src = rng.uniform(0, 300, (240, 2))
    dst = np.c_[src[:, 0] + 3 * np.sin(src[:, 1] / 20), src[:, 1]] + rng.uniform(-0.1, 0.1, src.shape)
    row = escalation.run_record(frame(spark, src, dst)).first()
    off = np.linalg.norm(registration.spline(src, dst)(src) - dst, axis=1)
    assert (row.method, row.n, row.passed) == ("tps", 240, True)
    assert row.rmse == pytest.approx(np.sqrt(np.mean(off**2)), abs=1e-9) and row.p95 == pytest.approx(np.percentile(off, 95), abs=1e-9)


def test_spline_in_parts_is_the_spline_in_one(spark, monkeypatch):
    """Points in blocks, some on the same place; vertices and points in groups."""
    for name, value in {"DIRECT": 100, "BLOCK": 120, "SIDE": 60, "AROUND": 250, "COARSE": 100, "PLACES": 150, "SOURCES": 200}.items():
        monkeypatch.setattr(spline, name, value)
    rng = np.random.default_rng(5)
    src = rng.uniform(0, 900, (350, 2))
    src[:5] = src[5]
    dst = np.c_[src[:, 0] + 3 * np.sin(src[:, 1] / 60), src[:, 1] - src[:, 0] / 9] + rng.uniform(-0.1, 0.1, src.shape)
    rows = spark.createDataFrame([(i, *map(float, (*a, *b))) for i, (a, b) in enumerate(zip(src, dst, strict=True))], "id bigint, x double, y double, tx double, ty double")
    weights, tail = spline.fit(rows)
    w, all_ = registration.spline_weights(src, dst), {r.id: (r.u, r.v) for r in weights.collect()}
    assert len(all_) == len(src) and np.abs(np.array([all_[i] for i in range(len(src))]) - w[:-3]).max() < 1e-6
    assert np.allclose(tail, w[-3:].T.ravel(), atol=1e-5)
    places = rng.uniform(0, 900, (400, 2))
    at = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(places)] + [(400, None, 1.0)], "k int, x double, y double")
    to = {r.k: (r.to.x, r.to.y) for r in spline.moved(at, ["k"], weights, tail).collect()}
    assert len(to) == 400 and np.abs(np.array([to[i] for i in range(400)]) - registration.spline(src, dst)(places)).max() < 1e-6
    monkeypatch.setattr(spline, "ROUNDS", 1)
    with pytest.raises(ValueError, match="residual"):
        spline.fit(rows)
    with pytest.raises(ValueError, match="line"):
        spline.fit(rows.withColumn("y", 2 * rows.x))


def test_rings_without_vertices_pass_the_spline(spark):
    src, dst = cases()["wave"]
    layer = spark.createDataFrame([("a", 1, None), ("b", 2, []), ("c", 3, [(10.0, 20.0), None, (30.0, 40.0)])], "parcel_id string, version int, ring array<struct<x: double, y: double>>")
    rows = {r.parcel_id: r for r in escalation.registered(layer, escalation.escalated(frame(spark, src, dst)), (0.0, 0.0)).collect()}
    assert rows["a"].ring is None and rows["b"].ring == [] and [r.version for _, r in sorted(rows.items())] == [2, 3, 4]
    first, middle, last = rows["c"].ring
    assert middle.x is None and np.allclose([first, last], registration.spline(src, dst)(np.array([[10.0, 20], [30, 40]])))
