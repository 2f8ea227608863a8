"""Registered queries of the write path, record lists, feature collections, layer registration, ingest and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RULES
from ..functions import geometry as g
from ..functions import projection
from ..operators import conflate, conflicts, evaluate, features, governance, matcher, registration, versions
from ..operators.spatial_join import distance_join, prefixed
from ..sources import fixtures, ingest
from .polygons import RINGS, ring_layer
from .queries import DECIDED, FIT, LATEST, PAIRS, TRUTH, Plan, query

# --- matches, conflicts, review cases -----------------------------------------------------------

CASES = DECIDED + """,
mt AS (SELECT concat('M-', substr(source_id, 3)) AS match_id, source_id, targets, relation, probability, CAST(substr(source_id, 3) AS BIGINT) AS seq FROM ro),
cf AS (SELECT concat('CF-', substr(source_id, 3)) AS conflict_id, conflict_type, 'HIGH' AS severity, concat('M-', substr(source_id, 3)) AS match_id, list_concat([source_id], targets) AS parcel_ids, msg AS message, CAST(substr(source_id, 3) AS BIGINT) AS seq FROM ro WHERE conflict_type IS NOT NULL),
rc AS (SELECT concat('RC-C-', substr(match_id, 3)) AS case_id, conflict_id, match_id FROM cf
  UNION ALL SELECT concat('RC-M-', substr(source_id, 3)), NULL, concat('M-', substr(source_id, 3)) FROM ro WHERE route = 'REVIEW' AND conflict_type IS NULL AND relation <> 'NO_MATCH'
  UNION ALL SELECT concat('RC-A-', substr(source_id, 3)), NULL, concat('M-', substr(source_id, 3)) FROM ro WHERE route = 'AUTO_ACCEPT' AND CAST('0x' || substr(md5(source_id), 1, 8) AS BIGINT) % 1000 < 100),
mx AS (SELECT parcel_id, max(version) AS last, max_by(dataset_id, version) AS dataset_id FROM log GROUP BY 1),
av AS (SELECT *, concat(parcel_id, '-v', version) AS version_key FROM (SELECT r.source_id, r.targets[1] AS target_id, probability, concat('P-', split_part(split_part(r.targets[1], '-', 2), '-', 1)) AS parcel_id,
  COALESCE(mx.last, 0) + row_number() OVER (PARTITION BY concat('P-', split_part(r.targets[1], '-', 2)) ORDER BY r.source_id) AS version FROM ro r LEFT JOIN mx ON mx.parcel_id = concat('P-', split_part(r.targets[1], '-', 2)) WHERE route = 'AUTO_ACCEPT') q)"""


class Desk:
    """The tables of the write path over one plan."""

    def __init__(self, p: Plan):
        self.routed = p.routed()
        self.matches = governance.match_table(self.routed)
        self.conflicts = governance.conflict_table(self.routed)
        self.cases = governance.review_cases(self.conflicts, self.routed)
        self.log = p.layer("parcel_version")

    def accepted(self, **how) -> DataFrame:
        return governance.accepted_versions(self.routed, self.log, _log_id(), **how)


def _log_id():
    """The log's id of the first target."""
    return F.concat(F.lit("P-"), F.regexp_extract(F.element_at("targets", 1), r"^S-(\d+)", 1))


@query("SELECT match_id, source_id, array_to_string(targets, ',') AS targets, relation, probability FROM mt ORDER BY seq DESC LIMIT 200", CASES)
def matches_newest(p: Plan) -> DataFrame:
    rows = features.newest(Desk(p).matches, 200, F.col("seq").desc())
    return rows.select("match_id", "source_id", F.array_join("targets", ",").alias("targets"), "relation", "probability")


@query("SELECT conflict_id, conflict_type, severity, match_id, array_to_string(parcel_ids, ',') AS parcel_ids, message FROM cf ORDER BY seq DESC LIMIT 200", CASES)
def conflicts_newest(p: Plan) -> DataFrame:
    rows = features.newest(Desk(p).conflicts, 200, F.col("seq").desc())
    return rows.select("conflict_id", "conflict_type", "severity", "match_id", F.array_join("parcel_ids", ",").alias("parcel_ids"), "message")


@query("SELECT case_id, conflict_id, match_id, 'OPEN' AS status FROM rc", CASES)
def review_cases(p: Plan) -> DataFrame:
    return Desk(p).cases


@query("""SELECT rc.case_id, rc.match_id, cf.conflict_type, cf.message, mt.relation, mt.probability, run.run_id FROM rc LEFT JOIN cf ON cf.conflict_id = rc.conflict_id LEFT JOIN mt ON mt.match_id = rc.match_id
  LEFT JOIN (SELECT max_by(run_id, {'c': created_at, 'r': row_id}) AS run_id, reference_dataset FROM run GROUP BY 2) run ON run.reference_dataset = concat('D', CAST(mt.seq % 4 AS VARCHAR))""", CASES + f", run AS ({fixtures.sql('pipeline_run', '//')})")
def review_case_detail(p: Plan) -> DataFrame:
    """A case with its conflict, its match and the newest run of the match's dataset, each if there is one."""
    d = Desk(p)
    newest = p.layer("pipeline_run").groupBy("reference_dataset").agg(F.max_by("run_id", F.struct("created_at", "row_id")).alias("run_id"))
    rows = d.cases.join(d.conflicts.select("conflict_id", "conflict_type", "message"), "conflict_id", "left").join(d.matches.select("match_id", "relation", "probability", "seq"), "match_id", "left")
    rows = rows.withColumn("reference_dataset", F.concat(F.lit("D"), F.col("seq") % 4)).join(newest, "reference_dataset", "left")
    return rows.select("case_id", "match_id", "conflict_type", "message", "relation", "probability", "run_id")


@query("SELECT source_id, target_id, parcel_id, version, probability, 'VALIDATED' AS status, 'registration>candidate_match>conflict_check>auto_accept' AS lineage FROM av", CASES)
def accepted_versions(p: Plan) -> DataFrame:
    return Desk(p).accepted().select("source_id", "target_id", "parcel_id", "version", "probability", "status", F.array_join("lineage", ">").alias("lineage"))


@query("SELECT source_id, parcel_id, version, 'registration>conflation>auto_accept' AS lineage, 'matcher-1.0-logreg' AS model FROM av", CASES)
def accepted_versions_legacy(p: Plan) -> DataFrame:
    rows = Desk(p).accepted(lineage=governance.LEGACY_LINEAGE, model=governance.LEGACY_MODEL)
    return rows.select("source_id", "parcel_id", "version", F.array_join("lineage", ">").alias("lineage"), "model")


@query("SELECT version_key, position, ['registration', 'candidate_match', 'conflict_check', 'auto_accept'][position + 1] AS step, concat('M-', substr(source_id, 3)) AS match_id FROM av, (SELECT unnest([0, 1, 2, 3])::INT AS position) z", CASES)
def provenance_rows(p: Plan) -> DataFrame:
    return governance.provenance_rows(Desk(p).accepted())


@query("SELECT 'VERSION_CREATED' AS event_type, 'parcel_version' AS entity_type, version_key AS entity_id, 'SYSTEM' AS actor_role FROM av UNION ALL SELECT 'AUDIT_SAMPLE', 'parcel_version', version_key, 'SYSTEM' FROM av WHERE CAST('0x' || substr(md5(source_id), 1, 8) AS BIGINT) % 1000 < 100", CASES)
def audit_rows(p: Plan) -> DataFrame:
    return governance.audit_rows(Desk(p).accepted(), RULES.audit_rate)


ACTED = CASES + """,
ac AS (SELECT concat('RA-', case_id) AS action_id, rc.*, ['APPROVE', 'REJECT', 'FIELD_VERIFY', 'EDIT', 'COMMENT'][CAST(substr(match_id, 3) AS BIGINT) % 5 + 1] AS action FROM rc),
ap0 AS (SELECT ac.*, concat('P-', CASE WHEN len(mt.targets) > 0 THEN split_part(mt.targets[1], '-', 2) ELSE substr(mt.source_id, 3) END) AS parcel_id FROM ac LEFT JOIN mt USING (match_id)),
ap AS (SELECT action_id, case_id, conflict_id, action, ap0.parcel_id, CASE WHEN action <> 'COMMENT' AND last IS NOT NULL THEN last + sum(CASE WHEN action <> 'COMMENT' AND last IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY ap0.parcel_id ORDER BY action_id ROWS UNBOUNDED PRECEDING) END::BIGINT AS version, last, dataset_id FROM ap0 LEFT JOIN mx ON mx.parcel_id = ap0.parcel_id)"""


def _acted(d: Desk) -> DataFrame:
    n = F.substring("match_id", 3, 20).cast("bigint") % 5
    names = F.array(*map(F.lit, ("APPROVE", "REJECT", "FIELD_VERIFY", "EDIT", "COMMENT")))
    actions = d.cases.select(F.concat(F.lit("RA-"), "case_id").alias("action_id"), "case_id", F.get(names, n.cast("int")).alias("action"), F.lit("edited").alias("attributes"))
    number = F.when(F.size("targets") > 0, F.regexp_extract(F.get("targets", F.lit(0)), r"^S-(\d+)", 1)).otherwise(governance.number("source_id"))
    return governance.apply_actions(actions, d.cases, d.matches, d.log, F.concat(F.lit("P-"), number))


@query("""SELECT action_id, case_id, action, parcel_id, version, CASE WHEN version IS NOT NULL THEN CASE action WHEN 'APPROVE' THEN 'APPROVED' WHEN 'REJECT' THEN 'REJECTED' WHEN 'FIELD_VERIFY' THEN 'FIELD_VERIFICATION' ELSE 'CANDIDATE' END END AS new_status,
  CASE WHEN version IS NOT NULL THEN CASE WHEN action = 'EDIT' THEN 'edited' ELSE dataset_id END END AS attributes, CASE WHEN action IN ('APPROVE', 'REJECT') THEN 'CLOSED' ELSE 'IN_PROGRESS' END AS case_status, conflict_id IS NOT NULL AND action = 'APPROVE' AS resolves FROM ap""", ACTED)
def review_action_results(p: Plan) -> DataFrame:
    """An action on every case: new versions, case states, resolutions."""
    return _acted(Desk(p))


@query("SELECT conflict_id, conflict_type, conflict_id IN (SELECT conflict_id FROM ap WHERE action = 'APPROVE' AND conflict_id IS NOT NULL) AS resolved FROM cf", ACTED)
def conflicts_resolved(p: Plan) -> DataFrame:
    d = Desk(p)
    return governance.resolve(d.conflicts, _acted(d), d.cases).select("conflict_id", "conflict_type", "resolved")


@query("SELECT conflict_id, match_id FROM cf WHERE conflict_id NOT IN (SELECT conflict_id FROM ap WHERE action = 'APPROVE' AND conflict_id IS NOT NULL)", ACTED)
def conflicts_unresolved(p: Plan) -> DataFrame:
    """What a stage reloads."""
    d = Desk(p)
    return governance.resolve(d.conflicts, _acted(d), d.cases).where("not resolved").select("conflict_id", "match_id")


@query("SELECT match_id, match_id IN (SELECT match_id FROM cf) AS conflicted FROM mt", CASES)
def matches_flagged(p: Plan) -> DataFrame:
    d = Desk(p)
    known = d.conflicts.select(F.col("match_id").alias("m")).distinct()
    return d.matches.join(known, F.col("match_id") == F.col("m"), "left").select("match_id", F.col("m").isNotNull().alias("conflicted"))


@query("SELECT source_id, t.id AS target_id, (xmin + xmax) / 2 AS x0, (ymin + ymax) / 2 AS y0, (g.x0 + g.x1) / 2 AS x1, (g.y0 + g.y1) / 2 AS y1 FROM (SELECT source_id, xmin, xmax, ymin, ymax, unnest(targets) AS id FROM de) t JOIN (SELECT parcel_id, xmin AS x0, xmax AS x1, ymin AS y0, ymax AS y1 FROM tgt) g ON g.parcel_id = t.id", DECIDED)
def match_lines(p: Plan) -> DataFrame:
    """A line from a source to each of its targets, whatever the relation."""
    rows = p.decided().select("source_id", "s_xmin", "s_ymin", "s_xmax", "s_ymax", F.explode("targets").alias("id"))
    rows = rows.join(prefixed(p.layer("target_parcel"), "t_"), F.col("id") == F.col("t_parcel_id"))
    (sx, sy), (tx, ty) = g.centroid(g.box("s_")), g.centroid(g.box("t_"))
    return rows.select("source_id", F.col("id").alias("target_id"), sx.alias("x0"), sy.alias("y0"), tx.alias("x1"), ty.alias("y1"))


@query("SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'GEOMETRY_INVALID' WHEN event_id % 7 = 0 THEN 'REGISTRATION_FAILURE' WHEN event_id % 5 = 0 THEN 'PARCEL_OVERLAP' WHEN event_type = 'error' THEN 'ATTRIBUTE_CONFLICT' WHEN event_type = 'view' THEN 'IDENTITY_CONFLICT' WHEN user_id % 2 = 0 THEN 'STRUCTURAL_AMBIGUITY' END AS kind FROM events")
def classified(p: Plan) -> DataFrame:
    flags = {"geometry_invalid": "event_id % 11 = 0", "registration_failed": "event_id % 7 = 0", "significant_overlap": "event_id % 5 = 0", "attribute_conflict": "event_type = 'error'", "ambiguous_identity": "event_type = 'view'", "structural_ambiguity": "user_id % 2 = 0"}
    rows = p.spark.read.parquet(f"{p.sf_dir}/events.parquet").withColumns({k: F.expr(v) for k, v in flags.items()})
    return rows.select("event_id", governance.classify().alias("kind"))


GATE = """,
pr AS (SELECT concat('r', row, 'c', col) AS region, quantile_cont(r, 0.95) AS p95 FROM reg GROUP BY 1),
gt AS (SELECT (SELECT count(*) FROM reg) AS n, (SELECT quantile_cont(r, 0.95) FROM reg) AS p95, (SELECT sqrt(avg(r * r)) FROM reg) AS rmse, (SELECT max(p95) FROM pr) AS worst_p95, (SELECT count(*) FROM pr WHERE p95 <= 0.75) AS passing_regions, (SELECT count(*) FROM pr WHERE p95 > 0.75) AS failing_regions)"""


@query("SELECT n, round(p95, 6) AS p95, round(rmse, 6) AS rmse, round(worst_p95, 6) AS worst_p95, passing_regions, failing_regions, failing_regions = 0 AND p95 <= 0.5 AS passed FROM gt", FIT + GATE)
def registration_quality(p: Plan) -> DataFrame:
    _, quality = registration.single_shot(p.layer("control_point"))
    return quality.select("n", *(F.round(c, 6).alias(c) for c in ("p95", "rmse", "worst_p95")), "passing_regions", "failing_regions", "passed")


@query("SELECT conflict_id, conflict_type, severity FROM cf, gt WHERE failing_regions = 0 AND p95 <= 0.01 UNION ALL SELECT 'CF-REGISTRATION', 'REGISTRATION_FAILURE', 'HIGH' FROM gt WHERE NOT (failing_regions = 0 AND p95 <= 0.01)", CASES + FIT + GATE)
def conflicts_gated(p: Plan) -> DataFrame:
    """Under a threshold of a centimetre registration fails, and its conflict is the only one."""
    _, quality = registration.single_shot(p.layer("control_point"), 0.01)
    return governance.gated(Desk(p).conflicts, quality.select("passed"))


@query("SELECT source_id, relation, CASE WHEN route = 'AUTO_ACCEPT' AND failing_regions = 0 AND p95 <= 0.5 THEN 'AUTO_ACCEPT' ELSE 'REVIEW' END AS route FROM ro, gt", DECIDED + FIT + GATE)
def route_registered(p: Plan) -> DataFrame:
    """Routing where the registration's gate is one of the nine conditions."""
    _, quality = registration.single_shot(p.layer("control_point"))
    rows = p.conflicted().crossJoin(F.broadcast(quality.select(F.col("passed").alias("registration_passed"))))
    return conflicts.route(rows).select("source_id", "relation", "route")


@query("SELECT point_id, sx AS from_x, sy AS from_y, round(px, 6) AS to_x, round(py, 6) AS to_y, round(r, 6) AS residual FROM res", FIT)
def residual_vectors(p: Plan) -> DataFrame:
    points = p.layer("control_point")
    rows = registration.with_residual(registration.apply_affine(points, registration.affine(points)))
    return registration.residual_vectors(rows).withColumns({c: F.round(c, 6) for c in ("to_x", "to_y", "residual")})


@query("""SELECT reg.row, reg.col, count(*) AS n, round(avg(r), 6) AS mean, round(quantile_cont(r, 0.95), 6) AS p95, round(least(avg(r) / greatest(quantile_cont(r, 0.95), 0.01), 1), 6) AS residual,
  round(min(x0) + (min(x1) - min(x0)) * reg.col / 3, 4) AS xmin, round(min(y0) + (min(y1) - min(y0)) * reg.row / 3, 4) AS ymin, round(min(x0) + (min(x1) - min(x0)) * (reg.col + 1) / 3, 4) AS xmax, round(min(y0) + (min(y1) - min(y0)) * (reg.row + 1) / 3, 4) AS ymax FROM reg, ext GROUP BY 1, 2""", FIT)
def heatmap_cells(p: Plan) -> DataFrame:
    points = p.layer("control_point")
    rows = registration.with_region(registration.with_residual(registration.apply_affine(points, registration.affine(points))))
    out = registration.heatmap_cells(rows)
    return out.withColumns({c: F.round(c, 6 if c in ("mean", "p95", "residual") else 4) for c in out.columns if c not in ("row", "col", "n")})


# --- lists and lookups --------------------------------------------------------------------------

RUNS = f", run AS ({fixtures.sql('pipeline_run', '//')}), ast AS ({fixtures.sql('asset', '//')})"


@query("SELECT dataset_id, min(created_at) AS created_at, count(DISTINCT parcel_id) AS parcels FROM log GROUP BY 1")
def datasets_listed(p: Plan) -> DataFrame:
    return p.layer("parcel_version").groupBy("dataset_id").agg(F.min("created_at").alias("created_at"), F.count_distinct("parcel_id").alias("parcels"))


@query("SELECT run_id, source_dataset, reference_dataset, status, created_at FROM run ORDER BY created_at DESC, row_id LIMIT 50", RUNS)
def runs_newest(p: Plan) -> DataFrame:
    return features.newest(p.layer("pipeline_run"), 50, F.col("created_at").desc(), F.col("row_id")).select("run_id", "source_dataset", "reference_dataset", "status", "created_at")


@query("SELECT run_id, source_dataset, reference_dataset, status, rmse FROM run WHERE run_id = 'R-7'", RUNS)
def run_by_id(p: Plan) -> DataFrame:
    return p.layer("pipeline_run").where("run_id = 'R-7'").select("run_id", "source_dataset", "reference_dataset", "status", "rmse")


@query("SELECT source_dataset, reference_dataset, max_by(run_id, {'c': created_at, 'r': row_id}) AS run_id, max_by(rmse, {'c': created_at, 'r': row_id}) AS rmse FROM run GROUP BY 1, 2", RUNS)
def latest_run_of_pair(p: Plan) -> DataFrame:
    """The newest registration of every pair of datasets."""
    newest = F.max_by(F.struct("run_id", "rmse"), F.struct("created_at", "row_id")).alias("n")
    return p.layer("pipeline_run").groupBy("source_dataset", "reference_dataset").agg(newest).select("source_dataset", "reference_dataset", "n.run_id", "n.rmse")


@query("SELECT event_id, event_type, user_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 100")
def audit_newest(p: Plan) -> DataFrame:
    events = p.spark.read.parquet(f"{p.sf_dir}/events.parquet")
    return features.newest(events, 100, F.col("ts").desc(), F.col("event_id")).select("event_id", "event_type", "user_id", "ts")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE json_extract_string(props, '$.k') = '7'")
def json_path_rows(p: Plan) -> DataFrame:
    rows = p.spark.read.parquet(f"{p.sf_dir}/events.parquet").withColumn("v", F.get_json_object("props", "$.k"))
    return rows.where("v = '7'").select("event_id", F.col("v").cast("int").alias("k"))


@query("SELECT point_id, sx, sy FROM cp")
def control_points_from_json(p: Plan) -> DataFrame:
    """Points kept as one JSON value for each ten of them, read back by path."""
    packed = p.layer("control_point").groupBy(F.floor(F.col("point_id") / 10).alias("block")).agg(F.to_json(F.struct(F.collect_list(F.struct("point_id", "sx", "sy")).alias("points"))).alias("meta"))
    points = F.from_json(F.get_json_object("meta", "$.points"), "array<struct<point_id: bigint, sx: double, sy: double>>")
    return packed.select(F.explode(points).alias("q")).select("q.*")


@query("SELECT count(DISTINCT parcel_id) AS parcels, count(*) AS versions FROM log")
def distinct_parcels(p: Plan) -> DataFrame:
    return p.layer("parcel_version").agg(F.count_distinct("parcel_id").alias("parcels"), F.count("*").alias("versions"))


@query("SELECT parcel_id, max(version) AS version, max_by(area, version) AS area FROM log GROUP BY 1")
def newest_geometry(p: Plan) -> DataFrame:
    return p.layer("parcel_version").groupBy("parcel_id").agg(F.max("version").alias("version"), F.max_by("area", "version").alias("area"))


@query("SELECT user_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY 1")
def last_key_wins(p: Plan) -> DataFrame:
    """Of rows under one key the last one stays."""
    return p.spark.read.parquet(f"{p.sf_dir}/events.parquet").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"))


@query("SELECT type, arg_min(asset_id, row_id) AS asset_id, arg_min(path, row_id) AS path FROM ast GROUP BY 1", RUNS)
def first_assets(p: Plan) -> DataFrame:
    return ingest.first_assets(p.layer("asset"))


@query("SELECT count(DISTINCT dataset_id) FILTER (WHERE dataset_id IN ('D1', 'D2')) = 2 AS ready FROM log")
def datasets_ready(p: Plan) -> DataFrame:
    return ingest.both_exist(p.layer("parcel_version"), "D1", "D2")


@query("SELECT 'BENCH-META' AS dataset_id, '{\"matched\":' || count(*) FILTER (WHERE relation_type = 'ONE_TO_ONE') || ',\"split\":' || count(*) FILTER (WHERE relation_type = 'SPLIT') || ',\"unmatched\":' || count(*) FILTER (WHERE relation_type = 'NO_MATCH') || '}' AS metadata FROM tk", TRUTH)
def metadata_dataset(p: Plan) -> DataFrame:
    """The known answers of a benchmark as one row of JSON beside the datasets."""
    count = lambda kind: F.count(F.when(F.col("relation_type") == kind, 1))
    return p.truth().agg(F.to_json(F.struct(count("ONE_TO_ONE").alias("matched"), count("SPLIT").alias("split"), count("NO_MATCH").alias("unmatched"))).alias("metadata")).select(F.lit("BENCH-META").alias("dataset_id"), "metadata")


@query("SELECT parcel_id FROM src WHERE k % 4 <> 0")
def ingest_new_parcels(p: Plan) -> DataFrame:
    feed = p.layer("source_parcel")
    return ingest.new_parcels(feed, feed.where("k % 4 = 0"))


@query("SELECT parcel_id, 1 AS version, 'OBSERVED' AS status, 'CAD' AS dataset_id, (xmax - xmin) * (ymax - ymin) AS area, CAST(to_json({'survey_no': survey_no, 'owner_name': owner_name, 'land_use': land_use}) AS VARCHAR) AS attributes FROM src")
def ingest_versions(p: Plan) -> DataFrame:
    feed = p.layer("source_parcel").select("parcel_id", "xmin", "ymin", "xmax", "ymax", "survey_no", "owner_name", "land_use")
    return ingest.first_versions(feed, "CAD")


@query("SELECT parcel_id, xmin AS x, ymin AS y, 'EPSG:32643' AS crs FROM src")
def layer_normalised(p: Plan) -> DataFrame:
    """A layer of mixed systems, a third of it in degrees, a third without any: all in metres again."""
    lon, lat = projection.to_wgs84("xmin", "ymin")
    mixed = p.layer("source_parcel").withColumn("crs", F.expr("CASE k % 3 WHEN 0 THEN 'EPSG:4326' WHEN 1 THEN 'EPSG:32643' END"))
    mixed = mixed.select("parcel_id", F.when(F.col("crs") == "EPSG:4326", F.expr(lon)).otherwise(F.col("xmin")).alias("x"), F.when(F.col("crs") == "EPSG:4326", F.expr(lat)).otherwise(F.col("ymin")).alias("y"), "crs")
    return ingest.normalise(mixed).select("parcel_id", *((F.round(F.col(c) * 16) / 16).alias(c) for c in "xy"), "crs")


# --- feature collections ------------------------------------------------------------------------


def _place(x: str, y: str) -> str:
    return f"'[' || CAST(CAST({x} AS DECIMAL(18, 7)) AS VARCHAR) || ',' || CAST(CAST({y} AS DECIMAL(18, 7)) AS VARCHAR) || ']'"


_BOX = " || ',' || ".join(_place(x, y) for x, y in (("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"), ("xmin", "ymin")))


@query(f"""SELECT parcel_id, '{{"type":"Feature","id":"' || parcel_id || '","geometry":{{"type":"Polygon","coordinates":[[' || {_BOX} || ']]}},"properties":{{"survey_no":"' || survey_no || '","land_use":"' || land_use || '","k":' || k || '}}}}' AS feature FROM src""")
def parcel_features(p: Plan) -> DataFrame:
    geometry = features.box_polygon(g.box())
    return p.layer("source_parcel").select("parcel_id", features.feature(F.col("parcel_id"), geometry, survey_no=F.col("survey_no"), land_use=F.col("land_use"), k=F.col("k")).alias("feature"))


@query(f"""SELECT obs_id, '{{"type":"Feature","id":"' || obs_id || '","geometry":{{"type":"Polygon","coordinates":[[' || {_BOX} || ']]}},"properties":{{"type":"' || type || '","confidence":' || CAST(CAST(confidence AS DECIMAL(9, 6)) AS VARCHAR) || '}}}}' AS feature FROM obs""")
def observation_features(p: Plan) -> DataFrame:
    return p.layer("observation").select("obs_id", features.feature(F.col("obs_id"), features.box_polygon(g.box()), type=F.col("type"), confidence=F.col("confidence").cast("decimal(9,6)")).alias("feature"))


@query(f"""SELECT point_id, '{{"type":"Feature","id":"' || point_id || '","geometry":{{"type":"Point","coordinates":' || {_place("x", "y")} || '}},"properties":{{}}}}' AS feature FROM pts""")
def survey_point_features(p: Plan) -> DataFrame:
    return p.layer("survey_point").select("point_id", features.feature(F.col("point_id"), features.point(F.col("x"), F.col("y"))).alias("feature"))


@query(f"""SELECT source_id, target_id, '{{"type":"Feature","id":"' || source_id || '","geometry":{{"type":"LineString","coordinates":[' || {_place("x0", "y0")} || ',' || {_place("x1", "y1")} || ']}},"properties":{{"target":"' || target_id || '"}}}}' AS feature FROM (
  SELECT source_id, t.id AS target_id, (xmin + xmax) / 2 AS x0, (ymin + ymax) / 2 AS y0, (g.x0 + g.x1) / 2 AS x1, (g.y0 + g.y1) / 2 AS y1 FROM (SELECT source_id, xmin, xmax, ymin, ymax, unnest(targets) AS id FROM de) t JOIN (SELECT parcel_id, xmin AS x0, xmax AS x1, ymin AS y0, ymax AS y1 FROM tgt) g ON g.parcel_id = t.id)""", DECIDED)
def match_features(p: Plan) -> DataFrame:
    ends = features.line((F.col("x0"), F.col("y0")), (F.col("x1"), F.col("y1")))
    return match_lines(p).select("source_id", "target_id", features.feature(F.col("source_id"), ends, target=F.col("target_id")).alias("feature"))


@query("SELECT conflict_id, l.parcel_id, l.xmin, l.ymin, l.xmax, l.ymax FROM (SELECT conflict_id, unnest(parcel_ids) AS id FROM cf) c JOIN (SELECT parcel_id, xmin, ymin, xmax, ymax FROM src UNION ALL SELECT parcel_id, xmin, ymin, xmax, ymax FROM tgt) l ON l.parcel_id = c.id", CASES)
def conflict_features(p: Plan) -> DataFrame:
    """One feature for each parcel a conflict names, with its newest geometry."""
    cols = ("parcel_id", "xmin", "ymin", "xmax", "ymax")
    both = p.layer("source_parcel").select(*cols).unionByName(p.layer("target_parcel").select(*cols))
    return Desk(p).conflicts.select("conflict_id", F.explode("parcel_ids").alias("parcel_id")).join(both, "parcel_id").select("conflict_id", *cols)


@query("""SELECT 'parcels' AS collection, count(*) AS items, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM tgt UNION ALL SELECT 'observations', count(*), min(xmin), min(ymin), max(xmax), max(ymax) FROM obs
  UNION ALL SELECT 'survey_points', count(*), min(x), min(y), max(x), max(y) FROM pts UNION ALL SELECT 'conflicts', count(*), min(xmin), min(ymin), max(xmax), max(ymax) FROM co WHERE conflict_type IS NOT NULL""", DECIDED)
def collections(p: Plan) -> DataFrame:
    """The registry of collections with sizes and extents."""
    found = p.conflicted().where("conflict_type is not null").select(*(F.col(f"s_{c}").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))
    points = p.layer("survey_point").select(F.col("x").alias("xmin"), F.col("y").alias("ymin"), F.col("x").alias("xmax"), F.col("y").alias("ymax"))
    out = None
    for name, rows in (("parcels", p.layer("target_parcel")), ("observations", p.layer("observation")), ("survey_points", points), ("conflicts", found)):
        row = rows.agg(F.count("*").alias("items"), F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax")).select(F.lit(name).alias("collection"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT parcel_id, survey_no, xmin, ymin FROM tgt WHERE parcel_id = 'S-17'")
def item_by_id(p: Plan) -> DataFrame:
    return p.layer("target_parcel").where("parcel_id = 'S-17'").select("parcel_id", "survey_no", "xmin", "ymin")


_DEGREES = (75.0011, 27.1205, 75.0072, 27.1232)


@query("SELECT parcel_id FROM (SELECT parcel_id, {0} AS lon0, {1} AS lat0, {2} AS lon1, {3} AS lat1 FROM tgt) WHERE lon0 <= {6} AND lon1 >= {4} AND lat0 <= {7} AND lat1 >= {5}".format(*projection.to_wgs84("xmin", "ymin"), *projection.to_wgs84("xmax", "ymax"), *_DEGREES))
def items_bbox_degrees(p: Plan) -> DataFrame:
    """A box in degrees; its corners in metres are constants, so the filter is four plain comparisons on the layer."""
    lon0, lat0, lon1, lat1 = _DEGREES
    (x0, y0), (x1, y1) = ([F.expr(e) for e in projection.to_utm(f"{lon}d", f"{lat}d")] for lon, lat in ((lon0, lat0), (lon1, lat1)))
    rows = p.layer("target_parcel")
    return rows.where((F.col("xmin") <= x1) & (F.col("xmax") >= x0) & (F.col("ymin") <= y1) & (F.col("ymax") >= y0)).select("parcel_id")


@query(f"SELECT parcel_id, version FROM ({LATEST} log WHERE dataset_id = 'D2') WHERE n = 1 AND CAST(split_part(parcel_id, '-', 2) AS BIGINT) % 50 < 10")
def parcels_in_envelope(p: Plan) -> DataFrame:
    """The newest versions of a dataset whose parcels lie in an envelope."""
    inside = p.layer("truth_box").where("xmin < 500410").select(F.concat(F.lit("P-"), governance.number("parcel_id")).alias("id"))
    return versions.latest_in_dataset(p.layer("parcel_version"), "D2").join(inside, F.col("parcel_id") == F.col("id"), "left_semi").select("parcel_id", "version")


# --- evaluation and the matcher -----------------------------------------------------------------

KNOWN = "k % 31 = 4 or k % 29 = 3 or k % 23 = 5"


def _found(p: Plan) -> DataFrame:
    return p.conflicted().where("conflict_type = 'ATTRIBUTE_CONFLICT'").select(F.col("source_id").alias("parcel_id"))


@query(f"SELECT COALESCE(f.id, n.id) AS parcel_id, CASE WHEN n.id IS NULL THEN 'false_alarm' WHEN f.id IS NULL THEN 'missed' ELSE 'hit' END AS outcome FROM (SELECT source_id AS id FROM co WHERE conflict_type = 'ATTRIBUTE_CONFLICT') f FULL JOIN (SELECT parcel_id AS id FROM src WHERE {KNOWN}) n ON n.id = f.id", DECIDED)
def conflict_ids(p: Plan) -> DataFrame:
    return evaluate.conflict_ids(_found(p), p.layer("source_parcel").where(KNOWN))


@query(f"""SELECT (SELECT COALESCE(round(avg(COALESCE(list_contains(refs, targets[1]), false)::INT), 6), 0) FROM ro LEFT JOIN tk ON source_id = legacy_id WHERE route = 'AUTO_ACCEPT') AS conflation_precision,
  (SELECT round(count(*) FILTER (WHERE parcel_id IN (SELECT source_id FROM co WHERE conflict_type = 'ATTRIBUTE_CONFLICT')) / count(*), 6) FROM src WHERE {KNOWN}) AS conflict_recall, (SELECT round(avg((route = 'AUTO_ACCEPT')::INT), 6) FROM ro) AS manual_effort_reduction,
  (SELECT count(*) FROM ro WHERE route = 'AUTO_ACCEPT' AND conflict_type IS NOT NULL) AS silent_errors, failing_regions = 0 AND p95 <= 0.5 AS registration_passed, round(worst_p95, 6) AS worst_p95, 0.95::DOUBLE AS precision_target, 0.95::DOUBLE AS recall_target, 0.5::DOUBLE AS effort_target FROM gt""", DECIDED + TRUTH + FIT + GATE)
def benchmark_summary(p: Plan) -> DataFrame:
    _, quality = registration.single_shot(p.layer("control_point"))
    return evaluate.summary(p.routed(), p.truth(), _found(p), p.layer("source_parcel").where(KNOWN), quality)


#: Weights that learning.fitted_weights finds on the training part of the pairs at scale 0.01, to two places (a test fits them again).
WEIGHTS, INTERCEPT = {"iou": 5.84, "centroid_distance": -0.12, "area_ratio": -3.94, "perimeter_ratio": -4.47, "shape_similarity": 8.94, "attribute_similarity": 9.96}, -7.54
_TERMS = " + ".join(f"{w}::DOUBLE * {c}" for w, c in zip(WEIGHTS.values(), ("iou", "cd", "ar", "pr", "sh", "att"), strict=True))
_P = "round(0.7::DOUBLE * iou + 0.2::DOUBLE * att + 0.1::DOUBLE * ident, 4) AS p"
assert _P in DECIDED
SCORED = DECIDED.replace(_P, f"round(1 / (1 + exp(-({INTERCEPT}::DOUBLE + {_TERMS}))), 4) AS p")


@query("SELECT source_id, relation, probability, array_to_string(targets, ',') AS targets FROM de", SCORED)
def relation_decision_fitted(p: Plan) -> DataFrame:
    """Decisions on the regression's probability instead of the rule's."""
    return p.decided(lambda rows: matcher.linear_score(rows, WEIGHTS, INTERCEPT)).select("source_id", "relation", "probability", F.array_join("targets", ",").alias("targets"))


@query("SELECT source_id, relation, route FROM ro", SCORED)
def route_fitted(p: Plan) -> DataFrame:
    return conflicts.route(conflicts.with_conflict(p.decided(lambda rows: matcher.linear_score(rows, WEIGHTS, INTERCEPT)))).select("source_id", "relation", "route")


@query("SELECT source_id, CASE WHEN probability > 0.9 THEN 'high' WHEN probability > 0.7 THEN 'medium' ELSE 'low' END AS band, COALESCE(e_geo >= 0.85 AND e_att >= 0.85 AND e_sur >= 0.5 AND e_phy >= 0.3 AND ident >= 0.8 AND probability >= 0.95 AND conflict_type IS NULL AND relation = 'ONE_TO_ONE', false) AS shown_acceptable FROM co", DECIDED)
def review_bands(p: Plan) -> DataFrame:
    """What a reviewer is shown: the band of the probability, and the stricter checklist of the desk."""
    prob = F.col("probability")
    least = {"e_geometry": 0.85, "e_attribute": 0.85, "e_survey": 0.5, "e_physical": 0.3, "e_temporal": 0.5, "e_identity": 0.8}
    good = (prob >= 0.95) & F.col("conflict_type").isNull() & (F.col("relation") == "ONE_TO_ONE")
    for c, v in least.items():
        good = good & (F.col(c) >= v)
    return p.conflicted(supports=True).select("source_id", F.when(prob > 0.9, "high").when(prob > 0.7, "medium").otherwise("low").alias("band"), F.coalesce(good, F.lit(False)).alias("shown_acceptable"))


@query("SELECT s.parcel_id AS source_id, t.parcel_id AS target_id, (list_contains(refs, t.parcel_id) AND refs IS NOT NULL)::INT AS y FROM src s JOIN tgt t ON t.xmin <= s.xmax + 50 AND t.xmax >= s.xmin - 50 AND t.ymin <= s.ymax + 50 AND t.ymax >= s.ymin - 50 AND sqrt(pow(greatest(0, s.xmin - t.xmax, t.xmin - s.xmax), 2) + pow(greatest(0, s.ymin - t.ymax, t.ymin - s.ymax), 2)) <= 50 JOIN tk ON tk.legacy_id = s.parcel_id", TRUTH)
def training_pairs(p: Plan) -> DataFrame:
    """Pairs within 50 m with their label: whether the target is among the source's known ones."""
    pairs = distance_join(prefixed(p.layer("source_parcel"), "s_"), prefixed(p.layer("target_parcel"), "t_"), "s_", "t_", 50.0).select("s_parcel_id", "t_parcel_id")
    rows = pairs.join(p.truth(), F.col("s_parcel_id") == F.col("legacy_id"))
    return rows.select(F.col("s_parcel_id").alias("source_id"), F.col("t_parcel_id").alias("target_id"), F.array_contains("reference_ids", F.col("t_parcel_id")).cast("int").alias("y"))
