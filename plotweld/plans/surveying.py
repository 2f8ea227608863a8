"""Registered queries of scenario tables, projection, homologous corners and registration by escalation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import projection
from ..operators import corners, escalation, registration
from ..operators.lineage import cut
from ..sources import fixtures, scenario
from ..streaming import versions as governing
from .queries import ORACLE, QUERIES, Plan, query


def _scenario(name: str) -> None:
    key = f"scenario_{name}"
    QUERIES[key] = lambda spark, sf_dir: scenario.scenario(spark, name)
    ORACLE[key] = scenario.oracle(name)


for _name in scenario.NAMES:
    _scenario(_name)

SX, SY = "(xmin + xmax) / 2", "(ymin + ymax) / 2"
LON, LAT = projection.to_wgs84(SX, SY)
BACK = projection.to_utm("lon", "lat")


@query(f"SELECT parcel_id, round(lon, 8) AS lon, round(lat, 8) AS lat, round({BACK[0]}, 3) AS x, round({BACK[1]}, 3) AS y FROM (SELECT parcel_id, {LON} AS lon, {LAT} AS lat FROM src) q")
def layer_wgs84(p: Plan) -> DataFrame:
    rows = p.layer("source_parcel").select("parcel_id", F.expr(LON).alias("lon"), F.expr(LAT).alias("lat"))
    return rows.select("parcel_id", F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"), F.round(F.expr(BACK[0]), 3).alias("x"), F.round(F.expr(BACK[1]), 3).alias("y"))


def _corner_sql(name: str) -> str:
    four = " UNION ALL ".join(f"SELECT parcel_id, {pos} AS pos, {x} AS x, {y} AS y FROM {name}" for pos, (x, y) in enumerate((("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"))))
    return f"SELECT min({{'i': parcel_id, 'p': pos, 'x': x, 'y': y}}) AS c FROM ({four}) q GROUP BY round(x, 4), round(y, 4)"


CORNERS = f""",
lb AS ({fixtures.sql("legacy_box", "//")}), tb AS ({fixtures.sql("truth_box", "//")}),
lc AS ({_corner_sql("lb")}), tc AS ({_corner_sql("tb")})"""


def _corners(p: Plan, name: str) -> DataFrame:
    return corners.corners(p.layer(name).select("parcel_id", corners.box_ring().alias("ring")))


@query("SELECT c.i AS parcel_id, c.p AS pos, c.x AS x, c.y AS y, 90.0::DOUBLE AS angle FROM lc", CORNERS)
def corners_dedup(p: Plan) -> DataFrame:
    return _corners(p, "legacy_box").withColumn("angle", F.round("angle", 6))


@query("""SELECT sx, sy, tx, ty, round(distance, 9) AS distance, concat(CASE WHEN sy >= median(sy) OVER () THEN 'N' ELSE 'S' END, CASE WHEN sx >= median(sx) OVER () THEN 'E' ELSE 'W' END) AS region FROM (
  SELECT sx, sy, b.x AS tx, b.y AS ty, b.d AS distance FROM (
    SELECT l.c.x AS sx, l.c.y AS sy, min({'d': sqrt((l.c.x + ox - t.c.x) ** 2 + (l.c.y + oy - t.c.y) ** 2), 'x': t.c.x, 'y': t.c.y}) AS b
    FROM lc l, (SELECT (SELECT (min(c.x) + max(c.x)) / 2 FROM tc) - (SELECT (min(c.x) + max(c.x)) / 2 FROM lc) AS ox, (SELECT (min(c.y) + max(c.y)) / 2 FROM tc) - (SELECT (min(c.y) + max(c.y)) / 2 FROM lc) AS oy) o
    JOIN tc t ON t.c.x BETWEEN l.c.x + ox - 50 AND l.c.x + ox + 50 AND t.c.y BETWEEN l.c.y + oy - 50 AND l.c.y + oy + 50
    GROUP BY 1, 2) q WHERE b.d <= 50 ORDER BY b.d, sx, sy LIMIT 100) z""", CORNERS)
def homologous_pairs(p: Plan) -> DataFrame:
    found = corners.homologous(_corners(p, "legacy_box"), _corners(p, "truth_box"))
    return found.withColumn("distance", F.round("distance", 9))


@query(None)
def escalation_log(p: Plan) -> DataFrame:
    """Methods tried on homologous corners, wrong ones left out, until one fits."""
    steps = escalation.escalated(_numbered(p).transform(escalation.ransac).where("inlier"))
    return steps.select("step", "method", "p95", "worst_p95", "accepted")


@query(None)
def ransac_helmert(p: Plan) -> DataFrame:
    """The similarity of homologous corners, and how many of them it fits."""
    found = escalation.ransac(_numbered(p))
    fit = registration.helmert(found.where("inlier"))
    return fit.crossJoin(found.agg(F.count(F.when(F.col("inlier"), 1)).alias("inliers"), F.count("*").alias("points")))


def _numbered(p: Plan) -> DataFrame:
    """The 100 pairs of corners that homologous() keeps at most, as control points about the layer's origin."""
    pairs = corners.homologous(_corners(p, "legacy_box"), _corners(p, "truth_box"))
    return cut(pairs).select(F.concat_ws(":", "sx", "sy").alias("point_id"), (F.col("sx") - 500000).alias("sx"), (F.col("sy") - 3000000).alias("sy"), (F.col("tx") - 500000).alias("tx"), (F.col("ty") - 3000000).alias("ty"))


REQUESTS = """,
rq AS (SELECT event_id, concat('P-', user_id) AS parcel_id, ts, CASE event_type WHEN 'signup' THEN 'CANDIDATE' WHEN 'click' THEN 'VALIDATED' WHEN 'view' THEN 'FIELD_VERIFICATION' WHEN 'purchase' THEN 'APPROVED' ELSE 'REJECTED' END AS requested, CASE WHEN event_id % 5 = 0 THEN 'AI_SERVICE' ELSE 'SURVEYOR' END AS role FROM events),
sq AS (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY ts, event_id) AS i FROM rq),
st(i, parcel_id, event_id, requested, status, version, accepted) AS (
  SELECT 0, parcel_id, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), 'OBSERVED', 0, false FROM rq GROUP BY parcel_id
  UNION ALL SELECT sq.i, sq.parcel_id, sq.event_id, sq.requested, CASE WHEN ok THEN sq.requested ELSE st.status END, st.version + ok::INT, ok FROM st JOIN sq ON sq.parcel_id = st.parcel_id AND sq.i = st.i + 1,
    LATERAL (SELECT concat(st.status, '>', sq.requested) IN ('OBSERVED>CANDIDATE', 'CANDIDATE>VALIDATED', 'CANDIDATE>REJECTED', 'CANDIDATE>FIELD_VERIFICATION', 'VALIDATED>APPROVED', 'VALIDATED>REJECTED', 'VALIDATED>FIELD_VERIFICATION', 'FIELD_VERIFICATION>CANDIDATE', 'FIELD_VERIFICATION>VALIDATED', 'FIELD_VERIFICATION>REJECTED') AND NOT (sq.role = 'AI_SERVICE' AND sq.requested = 'APPROVED') AS ok) o)"""


def review_requests(events: DataFrame) -> DataFrame:
    """Events as requests for a status of the parcel that bears the user's number."""
    asked = F.create_map(*(F.lit(x) for pair in {"signup": "CANDIDATE", "click": "VALIDATED", "view": "FIELD_VERIFICATION", "purchase": "APPROVED"}.items() for x in pair))
    role = F.when(F.col("event_id") % 5 == 0, "AI_SERVICE").otherwise("SURVEYOR")
    return events.select("event_id", F.concat(F.lit("P-"), F.col("user_id").cast("string")).alias("parcel_id"), "ts", F.coalesce(F.try_element_at(asked, F.col("event_type")), F.lit("REJECTED")).alias("requested"), role.alias("role"))


@query("SELECT parcel_id, event_id, requested, status, version::BIGINT AS version, accepted FROM st WHERE i > 0", REQUESTS)
def governed_events(p: Plan) -> DataFrame:
    """Every review event by the state machine, with the version it makes; the stream gives the same rows."""
    return governing.governed(review_requests(p.spark.read.parquet(f"{p.sf_dir}/events.parquet")))
