"""Registered queries of registration by escalation; the SQL is written from the rule, with sums and windows of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import escalation, registration, versions
from ..sources import fixtures
from .polygons import RINGS, ring_layer
from .queries import Plan, query

ORIGIN = (500000.0, 3000000.0)


def _similarity(points: str, by: str = "") -> str:
    """Similarities of a table of points, one for each value of `by`."""
    over, group, keep = (f"OVER (PARTITION BY {by})", f"GROUP BY {by}", f"{by}, ") if by else ("OVER ()", "", "")
    return f"""SELECT {keep}k * cos(w) AS a, -k * sin(w) AS b, mu - k * cos(w) * mx + k * sin(w) * my AS e, k * sin(w) AS c, k * cos(w) AS d, mv - k * sin(w) * mx - k * cos(w) * my AS f FROM (
  SELECT {keep}sqrt(sum((tx - mu) ** 2 + (ty - mv) ** 2) / sum((sx - mx) ** 2 + (sy - my) ** 2)) AS k, min(mx) AS mx, min(my) AS my, min(mu) AS mu, min(mv) AS mv,
    atan2(sum(((ty - mv) * (sx - mx) - (tx - mu) * (sy - my)) / ((sx - mx + 1e-12) ** 2 + (sy - my) ** 2)), sum(((tx - mu) * (sx - mx) + (ty - mv) * (sy - my)) / ((sx - mx + 1e-12) ** 2 + (sy - my) ** 2))) AS w
  FROM (SELECT *, avg(sx) {over} AS mx, avg(sy) {over} AS my, avg(tx) {over} AS mu, avg(ty) {over} AS mv FROM {points}) q {group}) z"""


def steps_sql(points: str) -> str:
    """Similarity and affine map of a table of points, judged by their worst region."""
    return f""",
mm AS (SELECT avg(sx) AS mx, avg(sy) AS my, avg(tx) AS mu, avg(ty) AS mv, min(sx) AS x0, max(sx) AS x1, min(sy) AS y0, max(sy) AS y1 FROM {points}),
aq AS (SELECT sum((sx - mx) ** 2) AS xx, sum((sx - mx) * (sy - my)) AS xy, sum((sy - my) ** 2) AS yy, sum((sx - mx) * (tx - mu)) AS xu, sum((sy - my) * (tx - mu)) AS yu, sum((sx - mx) * (ty - mv)) AS xv, sum((sy - my) * (ty - mv)) AS yv FROM {points}, mm),
af AS (SELECT a, b, mu - a * mx - b * my AS e, c, d, mv - c * mx - d * my AS f FROM mm, (SELECT (xu * yy - yu * xy) / (xx * yy - xy * xy) AS a, (xx * yu - xy * xu) / (xx * yy - xy * xy) AS b, (xv * yy - yv * xy) / (xx * yy - xy * xy) AS c, (xx * yv - xy * xv) / (xx * yy - xy * xy) AS d FROM aq) s),
mp AS (SELECT 1 AS step, 'helmert' AS method, * FROM ({_similarity(points)}) h UNION ALL SELECT 2, 'affine', a, b, e, c, d, f FROM af),
rs AS (SELECT step, method, least(floor((sy - y0) / greatest(y1 - y0, 1e-9) * 3), 2) AS i, least(floor((sx - x0) / greatest(x1 - x0, 1e-9) * 3), 2) AS j, sqrt((a * sx + b * sy + e - tx) ** 2 + (c * sx + d * sy + f - ty) ** 2) AS r FROM {points}, mm, mp),
wr AS (SELECT step, max(p) AS worst FROM (SELECT step, quantile_cont(r, 0.95) AS p FROM rs GROUP BY step, i, j) w GROUP BY 1),
al AS (SELECT rs.step, method, count(*) AS n, sqrt(avg(r * r)) AS rmse, quantile_cont(r, 0.95) AS p95, min(worst) AS worst_p95 FROM rs JOIN wr ON wr.step = rs.step GROUP BY 1, 2),
ch AS (SELECT min(step) FILTER (WHERE worst_p95 <= 0.75) AS first FROM al)"""


def _layer_sql(name: str) -> str:
    return f", pp AS ({fixtures.sql(name, '//')})"


STEPS = "SELECT step::INT AS step, method, round(rmse, 5) AS rmse, round(p95, 5) AS p95, round(worst_p95, 5) AS worst_p95, worst_p95 <= 0.75 AS accepted, COALESCE(step = first, false) AS chosen FROM al, ch WHERE step <= COALESCE(first, 2)"


def _steps(p: Plan, layer: str) -> DataFrame:
    steps = escalation.escalated(p.layer(layer))
    return steps.select("step", "method", *(F.round(c, 5).alias(c) for c in ("rmse", "p95", "worst_p95")), "accepted", "chosen")


@query(STEPS, _layer_sql("control_point") + steps_sql("pp"))
def registration_steps(p: Plan) -> DataFrame:
    """Points that a similarity takes well enough in every region: the one step that is tried."""
    return _steps(p, "control_point")


@query(STEPS, _layer_sql("control_point_sheared") + steps_sql("pp"))
def registration_steps_sheared(p: Plan) -> DataFrame:
    """Points under a shear: the similarity fails in some region, the affine map does not."""
    return _steps(p, "control_point_sheared")


@query(None)
def registration_steps_bent(p: Plan) -> DataFrame:
    """Points along a wave: both maps fail, the spline is tried."""
    return _steps(p, "control_point_bent")


@query("SELECT method, n, round(rmse, 5) AS rmse, round(p95, 5) AS p95, round(worst_p95, 5) AS worst_p95, worst_p95 <= 0.75 AS passed, CASE WHEN worst_p95 > 0.75 THEN 'REGISTRATION_FAILURE' END AS conflict_type FROM al, ch WHERE step = first", _layer_sql("control_point_sheared") + steps_sql("pp"))
def registration_run(p: Plan) -> DataFrame:
    """The record of a run: the method chosen and the figures of its own fit."""
    return escalation.run_record(p.layer("control_point_sheared")).withColumns({c: F.round(c, 5) for c in ("rmse", "p95", "worst_p95")})


_PLACED = ", ".join(f"round(a * (xs[{v + 1}] - 500000) + b * (ys[{v + 1}] - 3000000) + e + 500000, 4) AS x{v}, round(c * (xs[{v + 1}] - 500000) + d * (ys[{v + 1}] - 3000000) + f + 3000000, 4) AS y{v}" for v in range(4))


def _logged_rings(p: Plan) -> DataFrame:
    """Rings of the parcels whose newest version in the log is the dataset's, with that version."""
    newest = versions.latest_global_filtered(p.layer("parcel_version"), "D1").select(F.col("parcel_id").alias("logged"), F.col("version"))
    rings = ring_layer(p, "source_ring")
    return rings.join(newest, F.concat(F.lit("P-"), F.col("k").cast("string")) == F.col("logged")).select("parcel_id", "version", "ring")


def _flat(rows: DataFrame) -> DataFrame:
    corner = lambda v, c: F.round(F.get("ring", F.lit(v))[c], 4).alias(f"{c}{v}")
    return rows.select("parcel_id", F.col("version").cast("bigint").alias("version"), "status", "attributes", *(corner(v, c) for v in range(4) for c in "xy"), F.round("uncertainty", 6).alias("uncertainty"))


@query(f"""SELECT ra.parcel_id, (l.version + 1)::BIGINT AS version, 'CANDIDATE' AS status, '{{"stage":"registered"}}' AS attributes, {_PLACED}, round(p95, 6) AS uncertainty
  FROM ra JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY version DESC) AS nn FROM log) z WHERE nn = 1 AND dataset_id = 'D1') l ON substr(l.parcel_id, 3) = substr(ra.parcel_id, 3), al, ch, mp WHERE al.step = first AND mp.step = first""", RINGS + _layer_sql("control_point_sheared") + steps_sql("pp"))
def registered_layer(p: Plan) -> DataFrame:
    """The next version of every parcel of a dataset, numbered after the log and moved by the chosen fit."""
    return _flat(escalation.registered(_logged_rings(p), escalation.escalated(p.layer("control_point_sheared")), ORIGIN))


@query(None)
def layer_tps(p: Plan) -> DataFrame:
    """The layer moved by the spline, where that is the chosen fit."""
    return _flat(escalation.registered(_logged_rings(p), escalation.escalated(p.layer("control_point_bent")), ORIGIN))


RANSAC = f"""{_layer_sql("control_point_outliers")},
dr AS (SELECT i AS iteration, pp.*, row_number() OVER (PARTITION BY i ORDER BY md5(concat('42:', i, ':', point_id))) AS k FROM pp, range(1, 501) r(i)),
sm AS (SELECT * FROM dr WHERE k <= 3),
hm AS ({_similarity("sm", "iteration")}),
be AS (SELECT iteration FROM (SELECT iteration, count(*) FILTER (WHERE sqrt((a * sx + b * sy + e - tx) ** 2 + (c * sx + d * sy + f - ty) ** 2) < 2) AS n FROM pp, hm GROUP BY 1) s ORDER BY n DESC, iteration LIMIT 1),
i1 AS (SELECT pp.* FROM pp, hm JOIN be ON be.iteration = hm.iteration WHERE sqrt((a * sx + b * sy + e - tx) ** 2 + (c * sx + d * sy + f - ty) ** 2) < 2),
rf AS ({_similarity("i1")}),
fl AS (SELECT pp.*, sqrt((a * sx + b * sy + e - tx) ** 2 + (c * sx + d * sy + f - ty) ** 2) < 2 AS inlier FROM pp, rf)"""


@query("SELECT point_id, inlier FROM fl", RANSAC)
def ransac_plan(p: Plan) -> DataFrame:
    """Which control points the robust similarity keeps, a ninth of them being wrong."""
    return escalation.ransac(p.layer("control_point_outliers")).select("point_id", "inlier")


@query("SELECT method, n, round(rmse, 5) AS rmse, round(p95, 5) AS p95, round(worst_p95, 5) AS worst_p95, worst_p95 <= 0.75 AS passed, CASE WHEN worst_p95 > 0.75 THEN 'REGISTRATION_FAILURE' END AS conflict_type FROM al, ch WHERE step = first", RANSAC + ", kp AS (SELECT * FROM fl WHERE inlier)" + steps_sql("kp"))
def registration_run_robust(p: Plan) -> DataFrame:
    """A run on points of which a ninth is wrong: those go first, then the steps are tried."""
    kept = escalation.ransac(p.layer("control_point_outliers")).where("inlier")
    return escalation.run_record(kept).withColumns({c: F.round(c, 5) for c in ("rmse", "p95", "worst_p95")})


@query("SELECT concat('r', i::INT, 'c', j::INT) AS region, count(*) AS n, round(quantile_disc(r, 0.5), 6) AS p50, round(quantile_disc(r, 0.95), 6) AS p95 FROM rs WHERE step = 2 GROUP BY 1", _layer_sql("control_point") + steps_sql("pp"))
def residual_sketch(p: Plan) -> DataFrame:
    """Quantiles by region from mergeable sketches."""
    points = p.layer("control_point")
    rows = registration.with_region(registration.with_residual(registration.apply_affine(points, registration.affine(points))))
    return registration.regional_sketch(rows).withColumns({c: F.round(c, 6) for c in ("p50", "p95")})
