from pyspark.sql import functions as F

from plotweld.functions import rings
from plotweld.operators import observing

RING = "array<struct<x:double,y:double>>"


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def stage(spark, log):
    requests = spark.createDataFrame([("seen", True, 0.0, 0.0, 100.0, 100.0), ("dark", True, 0.0, 0.0, 100.0, 100.0), ("none", False, 0.0, 0.0, 30.0, 30.0), ("far", True, 1e6, 1e6, 2e6, 2e6)], "dataset_id string, with_height boolean, xmin double, ymin double, xmax double, ymax double")
    assets = spark.createDataFrame([("a2", "seen", "ORI", "p", 2), ("a1", "seen", "ORI", "p", 1), ("a0", "seen", "DSM", "p", 0), ("b", "dark", "ORI", "p", 3), ("c", "none", "DTM", "p", 4)], "asset_id string, dataset_id string, type string, path string, row_id int")
    extracted = spark.createDataFrame([("a1", "o1", "BUILDING", 0.7, 0.2, 6.0, box(1.0, 1.0, 4.0, 4.0)), ("a2", "o2", "WALL", 0.7, 0.2, None, box(1.0, 1.0, 4.0, 4.0)), ("a0", "o3", "WALL", 0.7, 0.2, None, box(1.0, 1.0, 4.0, 4.0))], f"asset_id string, obs_id string, type string, confidence double, uncertainty double, height double, ring {RING}")
    x0, y0, x1, y1 = rings.bounds(F.col("ring"))
    rows = spark.createDataFrame(log, f"parcel_id string, version int, ring {RING}").withColumns({"xmin": x0, "ymin": y0, "xmax": x1, "ymax": y1})
    return observing.evidence_stage(requests, assets, extracted, rows)


def inside(p, ring, slack=1e-6):
    turns = [(b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    return all(t > -slack for t in turns)


def test_images_first_and_stand_ins_where_they_show_nothing(spark):
    """One dataset has an image, one an image that shows nothing, one no image; only newest versions of roomy parcels that meet the extent give stand-ins."""
    slanted = [(50.0, 50.0), (80.0, 55.0), (75.0, 85.0), (45.0, 80.0)]
    log = [
        ("p", 1, box(5.0, 5.0, 9.0, 9.0)), ("p", 2, box(5.0, 5.0, 20.0, 15.0)), ("shrunk", 1, box(40.0, 5.0, 20.0, 20.0)), ("shrunk", 2, box(40.0, 5.0, 9.0, 9.0)),
        ("thin", 1, box(60.0, 5.0, 5.0, 40.0)), ("slant", 1, slanted), ("away", 1, box(500.0, 5.0, 20.0, 20.0)), ("void", 1, None), ("bare", 1, []),
    ]
    got = [r.asDict() for r in stage(spark, log).collect()]
    by = {d: [r for r in got if r["dataset_id"] == d] for d in ("seen", "dark", "none", "far")}
    assert [(r["obs_id"], r["model"], r["height"], r["parcel_id"]) for r in by["seen"]] == [("o1", observing.FROM_IMAGES, 6.0, None)]
    assert {r["parcel_id"] for r in by["dark"]} == {"p", "slant"} and {r["parcel_id"] for r in by["none"]} == {"p"} and not by["far"]
    shapes = {"p": [tuple(v) for v in log[1][2]], "slant": slanted}
    for r in by["dark"] + by["none"]:
        ring, high = [(v.x, v.y) for v in r["ring"]], r["dataset_id"] == "dark" and r["type"] == "BUILDING"
        assert r["model"] == observing.STAND_IN and (r["height"] is not None) == high and (not high or 5 <= r["height"] <= 12)
        low, top = observing.CONFIDENCE[r["type"]]
        assert low <= r["confidence"] <= top and all(inside(v, shapes[r["parcel_id"]]) for v in ring)
        if r["type"] == "WALL":
            assert len(ring) == 2 and set(ring) <= set(shapes[r["parcel_id"]])
    assert [sum(r["type"] == "BUILDING" for r in by[d]) for d in ("dark", "none")] == [2, 1]


def test_reruns_agree_and_walls_keep_their_share(spark):
    log = [(f"p{k}", 1, box(12.0 * (k % 8), 12.0 * (k // 8), 11.5, 11.5)) for k in range(64)]
    once, again = (sorted((r.obs_id, r.confidence, r.uncertainty, r.type) for r in stage(spark, log).where("dataset_id = 'dark'").collect()) for _ in range(2))
    walls = sum(r[3] == "WALL" for r in once)
    parcels = sum(r[3] == "BUILDING" for r in once)
    assert once == again and parcels > 30 and 0.5 < walls / (4 * parcels) < 0.7


def test_no_rows_at_all(spark):
    rows = stage(spark, [("void", 1, None)])
    assert [r.dataset_id for r in rows.collect()] == ["seen"] and rows.columns == observing.COLUMNS
