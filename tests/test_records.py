import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plotweld.functions import kernels, rings
from plotweld.operators import features, governance, matcher, registration
from plotweld.plans import polygons, queries, records, regions, registering  # noqa: F401  they register their queries
from plotweld.sources import ingest

DATA = "/root/testdata/sf0.01"
TABLES = "customer orders part supplier events".split()


def text(v):
    return repr(v + 0.0) if isinstance(v, float) else str([text(x) for x in v]) if isinstance(v, list) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables absent")
@pytest.mark.parametrize("name", ["best_match_ring", "orientation_ring", "merge_twins", "overlap_geometries", "accepted_versions", "review_action_results", "registered_layer", "registration_steps", "registration_run_robust", "decisions_ring", "fixed_rings", "parcel_features", "relation_decision_fitted", "ingest_versions"])
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    want = c.execute(queries.ORACLE[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(df.columns)
    rows = sorted(tuple(text(r[k]) for k in cols) for r in df.collect())
    assert rows and rows == sorted(tuple(text(v) for v in r) for r in want.fetchall())


def ring_of(points):
    return rings.ring(*((F.lit(float(x)), F.lit(float(y))) for x, y in points))


def values(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10)]


def test_rings_by_hand(spark):
    diamond, far, bow = [(5, -5), (15, 5), (5, 15), (-5, 5)], [(50, 50), (60, 50), (60, 60)], [(0, 0), (10, 10), (10, 0), (0, 10)]
    a, d = ring_of(SQUARE), ring_of(diamond)
    r = values(spark, area=rings.area(a), back=rings.signed_area(ring_of(SQUARE[::-1])), common=rings.common_area(a, d), none=rings.common_area(a, ring_of(far)), same=rings.common_area(a, ring_of(SQUARE[::-1])), length=rings.perimeter(d), h=rings.hausdorff(a, d), turned=rings.orientation_similarity(a, d), ok=rings.validity(a), bow=rings.validity(ring_of(bow)), two=rings.validity(ring_of(SQUARE[:2])), flat=rings.validity(ring_of([(0, 0), (1, 0), (2, 0)])))
    assert (r.area, r.back, r.common, r.none, r.same) == (100.0, -100.0, 100.0, 0.0, 100.0)
    assert abs(r.length - 40 * 2**0.5) < 1e-9 and abs(r.h - 5) < 1e-9 and 0 <= r.turned <= 1
    assert r.ok is None and r.bow in ("edges cross", "no area") and r.two == "too few vertices" and r.flat == "no area"


def test_clipping_against_numpy(spark):
    rng = np.random.default_rng(4)
    hulls = [kernels.hull(rng.uniform(0, 10, (8, 2)) + [500000, 3000000]) for _ in range(30)]
    rows = [(i, j, [tuple(map(float, v)) for v in hulls[i]], [tuple(map(float, v)) for v in hulls[j]]) for i in range(30) for j in range(3)]
    df = spark.createDataFrame(rows, "i int, j int, a array<struct<x: double, y: double>>, b array<struct<x: double, y: double>>")
    for r in df.select("i", "j", rings.common_area(F.col("a"), F.col("b")).alias("c")).collect():
        assert abs(r.c - kernels.clip_area(hulls[r.i] - hulls[r.j][0], hulls[r.j] - hulls[r.j][0])) < 1e-6


def test_registration_gate(spark):
    cols = "point_id int, sx double, sy double, tx double, ty double"
    rng = np.random.default_rng(2)
    points = [(i, float(x), float(y), float(x + 2 + rng.uniform(-0.05, 0.05)), float(y - 1)) for i, (x, y) in enumerate(rng.uniform(0, 100, (40, 2)))]
    fit, quality = registration.single_shot(spark.createDataFrame(points, cols))
    assert quality.first().passed and abs(fit.first().e - 2) < 0.1
    bad = [(i, x, y, tx + (30 if i < 6 else 0), ty) for i, x, y, tx, ty in points]
    assert not registration.single_shot(spark.createDataFrame(bad, cols))[1].first().passed
    assert not registration.single_shot(spark.createDataFrame([], cols))[1].first().passed


def test_review_actions(spark):
    cases = spark.createDataFrame([("RC-1", "CF-1", "M-1"), ("RC-2", None, "M-2"), ("RC-3", None, None)], "case_id string, conflict_id string, match_id string")
    matches = spark.createDataFrame([("M-1", "L-1", ["S-1"]), ("M-2", "L-2", [])], "match_id string, source_id string, targets array<string>")
    log = spark.createDataFrame([("S-1", 1, "old"), ("L-2", 4, "old")], "parcel_id string, version bigint, dataset_id string")
    actions = spark.createDataFrame([("1", "RC-1", "APPROVE", None), ("2", "RC-1", "EDIT", "new"), ("3", "RC-2", "REJECT", None), ("4", "RC-3", "APPROVE", None), ("5", "RC-2", "SHRUG", None), ("6", "gone", "APPROVE", None)], "action_id string, case_id string, action string, attributes string")
    got = {r.action_id: (r.parcel_id, r.version, r.new_status, r.attributes, r.case_status, r.resolves) for r in governance.apply_actions(actions, cases, matches, log, F.col("target_id")).collect()}
    assert got == {
        "1": ("S-1", 2, "APPROVED", "old", "CLOSED", True), "2": ("S-1", 3, "CANDIDATE", "new", "IN_PROGRESS", False), "3": ("L-2", 5, "REJECTED", "old", "CLOSED", False),
        "4": (None, None, None, None, "CLOSED", False), "5": ("L-2", None, None, None, "IN_PROGRESS", False),
    }


def test_ingest(spark, tmp_path):
    feed = spark.createDataFrame([("a", 75.0, 27.0, "EPSG:4326"), ("b", 500000.0, 3000000.0, None)], "parcel_id string, x double, y double, crs string")
    rows = {r.parcel_id: r for r in ingest.normalise(feed).collect()}
    assert abs(rows["a"].x - 500000) < 1e-3 and rows["b"].x == 500000.0 and rows["a"].crs == "EPSG:32643"
    with pytest.raises(Exception, match="unknown coordinate system"):
        ingest.normalise(feed.withColumn("crs", F.lit("EPSG:1"))).collect()
    old = spark.createDataFrame([("D1", "one"), ("D2", "two")], "dataset_id string, name string")
    new = spark.createDataFrame([("D2", "zwei"), ("D3", "drei")], "dataset_id string, name string")
    assert {tuple(r) for r in ingest.upsert_datasets(old, new).collect()} == {("D1", "one"), ("D2", "zwei"), ("D3", "drei")}
    name = features.feature(F.col("dataset_id"), F.lit(None).cast("string"), name=F.col("name"), none=F.lit(None).cast("string"))
    ingest.write_features(old.withColumn("name", F.lit('say "hi"')).select(name.alias("feature")), str(tmp_path / "f"))
    lines = spark.read.json(str(tmp_path / "f")).collect()
    assert {(r.id, r.geometry, r.properties.name) for r in lines} == {("D1", None, 'say "hi"'), ("D2", None, 'say "hi"')}


def test_matcher_is_the_same_after_saving(spark, tmp_path):
    rows = matcher.synthetic_pairs(spark, 200)
    model = matcher.fit(rows)
    matcher.save(model, str(tmp_path / "m"))
    again = matcher.load(str(tmp_path / "m"))
    assert {(r.id, r.p) for r in matcher.predict(model, rows).collect()} == {(r.id, r.p) for r in matcher.predict(again, rows).collect()}
