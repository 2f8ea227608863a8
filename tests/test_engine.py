import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plotweld.functions import geometry as g
from plotweld.functions import kernels
from plotweld.operators import conflate, conflicts, registration, versions
from plotweld.operators.spatial_join import distance_join, prefixed
from plotweld.plans import queries as engine

DATA = "/root/testdata/sf0.01"
TABLES = "customer orders part supplier events".split()


def text(v):
    return repr(v + 0.0) if isinstance(v, float) else str([text(x) for x in v]) if isinstance(v, list) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables absent")
@pytest.mark.parametrize("name", ["best_match_ranked", "relation_decision", "route_candidates", "gnss_support", "latest_among_hits", "residual_stats", "relation_accuracy", "state_machine_violations"])
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = engine.QUERIES[name](spark, DATA)
    want = c.execute(engine.ORACLE[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(tuple(text(r[k]) for k in cols) for r in df.collect()) == sorted(tuple(text(v) for v in r) for r in want.fetchall())


def boxes(spark, rows):
    return spark.createDataFrame([(i, *map(float, b)) for i, b in rows], "parcel_id string, xmin double, ymin double, xmax double, ymax double")


def test_distance_join_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    make = lambda n: [(f"{i}", (x, y, x + w, y + h)) for i, (x, y, w, h) in enumerate(zip(rng.uniform(-300, 300, n), rng.uniform(-300, 300, n), rng.uniform(0, 200, n), rng.uniform(0, 60, n)))]  # noqa: E731, B905
    a, b = make(60), make(60)
    got = distance_join(prefixed(boxes(spark, a), "s_"), prefixed(boxes(spark, b), "t_"), "s_", "t_", 7.0).select("s_parcel_id", "t_parcel_id").collect()
    gap = lambda p, q: np.hypot(max(0, p[0] - q[2], q[0] - p[2]), max(0, p[1] - q[3], q[1] - p[3]))
    want = {(i, j) for i, p in a for j, q in b if gap(p, q) <= 7}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def features(spark, a, b):
    cols = "parcel_id string, xmin double, ymin double, xmax double, ymax double, survey_no string, owner_name string, land_use string, revenue_area double, sigma double"
    s = spark.createDataFrame([("a", *map(float, a), "A", "o", "u", 100.0, 0.25)], cols)
    t = spark.createDataFrame([("b", *map(float, b), "A", "o", "u", 100.0, 0.25)], cols)
    return conflate.rule_probability(conflate.with_features(prefixed(s, "s_").crossJoin(prefixed(t, "t_")))).first()


def test_pair_features(spark):
    near = features(spark, (0, 0, 10, 10), (0.2, -0.1, 10.2, 9.9))
    assert near.iou > 0.8 and near.p > 0.7 and near.attribute_similarity == 1.0
    far = features(spark, (0, 0, 10, 10), (100, 100, 110, 110))
    assert far.iou < 0.01 and far.centroid_distance > 50


def layers(spark, sources, targets):
    cols = "parcel_id string, xmin double, ymin double, xmax double, ymax double, survey_no string, owner_name string, land_use string, revenue_area double, sigma double"
    make = lambda rows: spark.createDataFrame([(i, *map(float, b), "A", "o", "u", float((b[2] - b[0]) * (b[3] - b[1])), 0.25) for i, b in rows], cols)
    return make(sources), make(targets)


def test_split_and_no_candidate(spark):
    s, t = layers(spark, [("p", (0, 0, 20, 10)), ("q", (900, 0, 910, 10))], [("x", (0, 0, 10, 10)), ("y", (10, 0, 20, 10))])
    rows = conflate.candidates(s, t)
    scored = conflate.with_features(rows).withColumn("p", F.lit(0.65)).withColumns({f"e_{d}": F.lit(0.5) for d in ("geometry", "attribute", "survey", "physical", "temporal", "identity")})
    got = {r.source_id: (r.relation, r.targets) for r in conflate.decide(s, scored).collect()}
    assert got == {"p": ("SPLIT", ["x", "y"]), "q": ("NO_MATCH", [])}


def test_merge(spark):
    s, t = layers(spark, [("p", (0, 0, 10, 10)), ("q", (10, 0, 20, 10))], [("m", (0, 0, 20, 10))])
    decided = spark.createDataFrame([("p", "ONE_TO_ONE", ["m"]), ("q", "ONE_TO_ONE", ["m"])], "source_id string, relation string, targets array<string>")
    assert [tuple(r) for r in conflate.merges(decided, s, t).select("target_id", "sources", "probability").collect()] == [("m", ["p", "q"], 0.85)]


def test_overlaps(spark):
    layer = boxes(spark, [("a", (0, 0, 10, 10)), ("b", (9, 0, 19, 10)), ("c", (19, 0, 29, 10))])
    assert [(r.a_parcel_id, r.b_parcel_id, r.share) for r in conflicts.overlaps(layer).collect()] == [("a", "b", 0.1)]


def test_ai_may_not_publish(spark):
    log = spark.createDataFrame([("p", 1, "OBSERVED", 1)], "parcel_id string, version bigint, status string, row_id bigint")
    new = spark.createDataFrame([("p", "PUBLISHED", 2)], "parcel_id string, status string, row_id bigint")
    with pytest.raises(Exception, match="may not approve"):
        versions.governed_append(log, new, "AI_SERVICE").collect()
    assert sorted(r.version for r in versions.governed_append(log, new, "SURVEYOR").collect()) == [1, 2]


def test_registration_kernels():
    square = np.array([[0, 0], [10, 0], [10, 10], [0, 10]], float)
    m = registration.helmert_fit(square, square + [1.2, -0.7])
    assert np.allclose(m[:2, 2], [1.2, -0.7], atol=1e-6)
    a = np.deg2rad(0.8)
    turn = np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
    assert abs(np.rad2deg(np.arctan2(*registration.helmert_fit(square, square @ turn.T)[[1, 0], 0])) - 0.8) < 0.05


def test_kernels():
    a, b = np.array([[0, 0], [10, 0], [10, 10], [0, 10]], float), np.array([[5, 5], [15, 5], [15, 15], [5, 15]], float)
    assert kernels.clip_area(a, b) == 25 and kernels.clip_area(a, b + 50) == 0
    assert abs(abs(kernels.signed_area(kernels.inset(a, 2))) - 36) < 1e-9
    assert len(kernels.hull(np.r_[a, [[5, 5]]])) == 4
    assert len(kernels.simplify(np.array([[0, 0], [5, 0.1], [10, 0]], float), 0.5)) == 2
    ring, done = kernels.tidy(np.array([[0, 0], [0, 0], [1, 0], [1, 1]], float))
    assert done == ["removed_duplicate_vertices", "closed_ring"] and len(ring) == 4


def test_envelope_and_radius(spark):
    row = spark.range(1).select(g.search_radius(F.lit(0.05), 0.1, 3.0, 1.0).alias("r"), g.relative_uncertainty(F.lit(0.5), F.lit(0.5), F.lit(0.8)).alias("u")).first()
    assert row.r == 1.0 and 3 * row.u < 4.0
