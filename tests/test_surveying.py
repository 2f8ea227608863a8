import math

import numpy as np
from pyspark.sql import functions as F

from plotweld.functions import projection
from plotweld.operators import corners
from plotweld.sources import scenario


def test_projection_agrees_with_the_meridian_arc(spark):
    lon, lat = projection.to_wgs84("x", "y")
    row = spark.sql("SELECT 500000D AS x, 3000000D AS y").select(F.expr(lon).alias("lon"), F.expr(lat).alias("lat")).first()
    e2 = projection.FLATTENING * (2 - projection.FLATTENING)
    phi = np.linspace(0, math.radians(row.lat), 200_001)
    arc = np.trapezoid(projection.AXIS * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5, phi)
    assert abs(row.lon - 75) < 1e-12 and abs(arc * 0.9996 - 3000000) < 1e-3
    x, y = projection.to_utm("lon", "lat")
    far = spark.sql("SELECT 77.3D AS lon, 12.5D AS lat").select(F.expr(x).alias("x"), F.expr(y).alias("y"))
    back = far.select(F.expr(lon).alias("lon"), F.expr(lat).alias("lat")).first()
    assert abs(back.lon - 77.3) < 1e-8 and abs(back.lat - 12.5) < 1e-8


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def test_corners(spark):
    rows = [("a", ring((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))), ("b", ring((10, 0), (20, 0), (10, 10))), ("c", []), ("d", None), ("e", ring((50, 50)))]
    got = {(r.x, r.y): r for r in corners.corners(spark.createDataFrame(rows, "parcel_id string, ring array<struct<x:double,y:double>>")).collect()}
    assert len(got) == 6 and got[10, 0].parcel_id == "a" and abs(got[10, 0].angle - 90) < 1e-9
    assert abs(got[20, 0].angle - 45) < 1e-9 and got[50, 50].angle is None


def test_homologous_against_brute_force(spark):
    rng = np.random.default_rng(3)
    a, b = rng.uniform(0, 400, (60, 2)).round(3), rng.uniform(0, 400, (70, 2)).round(3)
    frame = lambda m: spark.createDataFrame([(float(x), float(y), None) for x, y in m], "x double, y double, angle double")
    got = {(r.sx, r.sy): (r.tx, r.ty) for r in corners.homologous(frame(a), frame(b)).collect()}
    o = (b.min(0) + b.max(0)) / 2 - (a.min(0) + a.max(0)) / 2
    d = np.hypot(*(a[:, None] + o - b[None]).transpose(2, 0, 1))
    want = {tuple(a[i]): tuple(b[d[i].argmin()]) for i in range(60) if d[i].min() <= 50}
    assert got == want
    assert corners.homologous(frame(a), frame(b[:0])).count() == 0


def test_scenario(spark):
    rows = {n: scenario.scenario(spark, n).toPandas() for n in scenario.NAMES}
    assert [len(rows[n]) for n in scenario.NAMES] == [30, 30, 29, 30, 5, 120, 16]
    truth, survey = rows["truth"].set_index("parcel_id"), rows["survey"].set_index("parcel_id")
    assert abs(survey.revenue_area["S-202"] + survey.revenue_area["S-203"] - truth.revenue_area["P-104"]) < 0.02
    assert "L-P-026" not in set(rows["legacy"].parcel_id)
    assert scenario.scenario(spark, "truth", 40, 50).select("parcel_id").distinct().count() == 1998  # 103 and 104 are taken twice
