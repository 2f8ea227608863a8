import os
import random
from datetime import date, datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from plotweld.functions import rings
from plotweld.operators import features, ledger
from plotweld.plans import ledger as plans  # noqa: F401  it registers its queries
from plotweld.plans import queries

DATA = "/root/testdata/sf0.01"
LOG = "parcel_id string, version long, status string, ring array<struct<x: double, y: double>>, attributes struct<use: string, holder: string>, source_ids array<string>"
ACTION = "action_id long, case_id string, parcel_id string, action string, role string, attributes struct<use: string, holder: string>, wkt string"
GIVES = {"EDIT": "CANDIDATE", "APPROVE": "APPROVED", "REJECT": "REJECTED", "FIELD_VERIFY": "FIELD_VERIFICATION"}


def text(v):
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables absent")
@pytest.mark.parametrize("name", ["versions_created", "version_provenance", "edits_applied", "event_features"])
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for t in "customer orders part supplier events".split():
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    want = c.execute(queries.ORACLE[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(df.columns)
    rows = sorted(tuple(text(r[k]) for k in cols) for r in df.collect())
    assert rows and rows == sorted(tuple(text(v) for v in r) for r in want.fetchall())


def square(x, size):
    x, size = float(x), float(size)
    return [(x, 0.0), (x + size, 0.0), (x + size, size), (x, size)]


def replay(log, actions):
    """The actions one after the other, each on the newest version so far."""
    newest = {}
    for p, v, _, ring, attributes, sources in sorted(log, key=lambda r: r[1]):
        newest[p] = (v, ring, attributes, sources)
    out = {}
    for i, _, p, action, role, attributes, wkt in sorted(actions):
        status = GIVES.get(action)
        if status is None or p not in newest or (role == "AI_SERVICE" and status == "APPROVED"):
            out[i] = None
            continue
        v, ring, old, sources = newest[p]
        if action == "EDIT":
            old = tuple(o if n is None else n for o, n in zip(old, attributes or (None, None), strict=True))
            ring = [tuple(map(float, q.split())) for q in wkt[10:-2].split(",")][:-1] if wkt and wkt.startswith("POLYGON") else ring
        newest[p] = (v + 1, ring, old, sources)
        out[i] = (v + 1, status, ring, old, sources)
    return out


def test_edits_as_a_replay(spark):
    rng = random.Random(5)
    log = [(f"P{k}", v, "OBSERVED", square(k, v), (f"u{v}", f"h{k}"), ["D1", f"D{v}"]) for k in range(8) for v in range(1, rng.randint(2, 4))]
    actions = []
    for i in range(300):
        wkt = rng.choice([None, "POINT (1 1)", "POLYGON ((0 0, 3 0, 3 %d, 0 0))" % rng.randint(1, 9)])
        attributes = rng.choice([None, (None, None), (f"u-{i}", None), (None, f"h-{i}"), (f"u-{i}", f"h-{i}")])
        # A third of all actions are on one parcel; P8 and P9 are not in the log.
        actions.append((i, f"RC{i}", "P0" if i % 3 == 0 else f"P{rng.randrange(10)}", rng.choice([*GIVES, "COMMENT", None]), rng.choice(["AI_SERVICE", "REVIEWER", None]), attributes, wkt))
    out = ledger.edited(spark.createDataFrame(log, LOG), spark.createDataFrame(actions, ACTION))
    rows = {r.action_id: None if r.version is None else (r.version, r.status, [tuple(v) for v in r.ring], tuple(r.attributes), r.source_ids) for r in out.collect()}
    assert rows == replay(log, actions)
    assert {r.case_status for r in out.where("action = 'APPROVE'").collect()} == {"CLOSED"} and {r.case_status for r in out.where("action is null").collect()} == {"IN_PROGRESS"}
    refused = out.where("refusal is not null").collect()
    assert refused and all(r.role == "AI_SERVICE" and r.action == "APPROVE" and r.version is None for r in refused)


def test_requests_are_numbered_or_refused(spark):
    log = spark.createDataFrame([("P", 4, "OBSERVED", None, None, None)], LOG)
    asked = [(1, "P", "CANDIDATE", "AI_SERVICE"), (2, "P", "PUBLISHED", "AI_SERVICE"), (3, "P", "PUBLISHED", "SYSTEM"), (4, "Q", "VALIDATED", None), (5, "Q", None, "AI_SERVICE"), (6, "Q", "OBSERVED", "AI_SERVICE")]
    requests = spark.createDataFrame([(*a, ["S"], ["step"]) for a in asked], "request_id long, parcel_id string, status string, role string, source_ids array<string>, lineage array<string>")
    made = ledger.created(log, requests)
    assert {r.request_id: (r.version, r.refusal) for r in made.collect()} == {
        1: (5, None), 2: (None, "AI_SERVICE cannot create status PUBLISHED"), 3: (6, None), 4: (1, None), 5: (None, "AI_SERVICE cannot create status null"), 6: (2, None),
    }
    assert ledger.audit(made).count() == 4 and ledger.created(log, requests.limit(0)).count() == 0
    steps = ledger.provenance(made)
    rows = {r.version_key: r.provenance for r in ledger.chains(log.select("parcel_id", "version", "status").unionByName(made.where("version is not null").select("parcel_id", "version", "status")), steps.unionByName(steps)).collect()}
    assert {k: len(v) for k, v in rows.items()} == {"P-v4": 0, "P-v5": 2, "P-v6": 2, "Q-v1": 2, "Q-v2": 2}
    assert rows["P-v5"][0].lineage == ["step"] and rows["P-v5"][0].derived_from == ["S"] and rows["P-v5"][0].match_model is None


def test_rings_from_text(spark):
    texts = {
        "POLYGON ((0 0, 4 0, 4 3, 0 0))": 6.0, " polygon((0 0,4 0,4 3.5,0 0)) ": 7.0, "POLYGON ((0 0, 4 0, 4 3))": 6.0, "POLYGON ((1e1 0, 14 0, 14 -3, 10 0))": 6.0,
        "POLYGON ((0 0, 4 0, 0 0))": None, "POLYGON ((0 0, 4 0, x 3, 0 0))": None, "POLYGON ((0 0, 4 0, 4 3 1, 0 0))": None, "POLYGON ((0 0, 4, 4 3, 0 0))": None,
        "POLYGON ((0 0, 9 0, 9 9, 0 0), (1 1, 2 1, 2 2, 1 1))": None, "POLYGON EMPTY": None, "POINT (1 1)": None, "": None,
    }
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", rings.area(rings.from_wkt(F.col("t"))).alias("a"))
    assert {r.t: r.a for r in df.collect()} == texts | {None: None}


def test_rows_as_features(spark):
    rows = [("a\"b", 1, datetime(2024, 5, 6, 7, 8, 9), date(2024, 1, 2), (5, "in"), {"k": "v", "n": None}, None), (None, None, datetime(2024, 5, 6, 7, 8, 9, 1200), None, None, None, "{}")]
    df = spark.createDataFrame(rows, "id string, n long, at timestamp, day date, nested struct<m: long, word: string>, more map<string, string>, geom string")
    got = [r.feature for r in features.row_features(df, "id", F.col("geom"), ("geom",)).collect()]
    assert got[0] == '{"type":"Feature","id":"a\\"b","geometry":null,"properties":{"at":"2024-05-06T07:08:09+00:00","day":"2024-01-02","k":"v","m":5,"n":null,"word":"in"}}'
    assert got[1] == '{"type":"Feature","id":"","geometry":{},"properties":{"at":"2024-05-06T07:08:09.001200+00:00","day":null,"m":null,"n":null,"word":null}}'


def test_membership_is_by_any_source(spark):
    log = spark.createDataFrame([("P", 1, "A", None, None, ["D1", "D2"]), ("P", 2, "B", None, None, ["D2"]), ("Q", 1, "C", None, None, None), ("R", 1, "D", None, None, [])], LOG)
    assert [(r.parcel_id, r.version) for r in ledger.of_dataset(log, "D1").collect()] == [("P", 1)]
    assert [(r.parcel_id, r.version) for r in ledger.of_dataset(log, "D2").collect()] == [("P", 2)]
