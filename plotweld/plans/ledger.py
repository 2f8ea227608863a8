"""Registered queries of the version ledger: requests, edits, provenance, membership, the desk's state, rows as features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rings
from ..operators import features, governance, ledger
from ..operators.lineage import cut
from ..sources import fixtures
from .queries import Plan, query
from .records import CASES

_ED = f""",
ed AS ({fixtures.sql("parcel_edition", "//")}), rq AS ({fixtures.sql("version_request", "//")}), ml AS (SELECT parcel_id, max(version) AS last, arg_max(land_use, version) AS land_use, arg_max(holder, version) AS holder, arg_max(w * h, version) AS area, arg_max([dataset_1, dataset_2], version) AS ds FROM ed GROUP BY 1)"""
_REFUSED = "role = 'AI_SERVICE' AND {0} IN ('APPROVED', 'PUBLISHED')"
_MADE = _ED + f""",
cr AS (SELECT rq.*, CASE WHEN {_REFUSED.format('rq.status')} THEN 'AI_SERVICE cannot create status ' || rq.status END AS refusal, COALESCE(last, 0) AS last FROM rq LEFT JOIN ml USING (parcel_id)),
cv AS (SELECT *, CASE WHEN refusal IS NULL THEN last + row_number() OVER (PARTITION BY parcel_id, refusal IS NULL ORDER BY request_id) END AS version FROM cr)"""
#: An edit's shape is an L: a square of 20 with an arm of 20 by `arm` beside it.
_EDITS = _ED + f""",
ac AS (SELECT rq.*, CASE action WHEN 'EDIT' THEN 'CANDIDATE' WHEN 'APPROVE' THEN 'APPROVED' WHEN 'REJECT' THEN 'REJECTED' WHEN 'FIELD_VERIFY' THEN 'FIELD_VERIFICATION' END AS gives FROM rq),
am AS (SELECT ac.* EXCLUDE (land_use, holder), ac.land_use AS new_use, ac.holder AS new_holder, ml.last, ml.land_use, ml.holder, ml.area, ml.ds, gives IS NOT NULL AND last IS NOT NULL AND NOT ({_REFUSED.format("gives")}) AS makes FROM ac LEFT JOIN ml USING (parcel_id))"""


def editions(p: Plan) -> DataFrame:
    """The ledger: editions as versions with a ring, attributes and sources."""
    box = (F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"))
    ring = rings.ring((box[0], box[1]), (box[2], box[1]), (box[2], box[3]), (box[0], box[3]))
    rows = p.layer("parcel_edition")
    return rows.select("parcel_id", "version", "status", ring.alias("ring"), F.struct("land_use", "holder").alias("attributes"), F.array("dataset_1", "dataset_2").alias("source_ids"), F.col("run_id").alias("registration_run_id"))


def _requested(p: Plan) -> DataFrame:
    """Requests as versions to be: their sources are a review, their steps the registration and the request."""
    rows = p.layer("version_request").select("request_id", "parcel_id", "status", "role", F.col("run_id").alias("registration_run_id"))
    return rows.withColumns({"source_ids": F.array(F.lit("REVIEW")), "lineage": F.array(F.lit("registration"), F.concat(F.lit("request "), "request_id")), "review_case_id": F.concat(F.lit("RC-"), "request_id")})


@query("SELECT request_id, parcel_id, status, refusal, version FROM cv", _MADE)
def versions_created(p: Plan) -> DataFrame:
    """Requests for versions, numbered one after the other; those an AI service may not make are refused and take no number."""
    return ledger.created(editions(p), _requested(p)).select("request_id", "parcel_id", "status", "refusal", "version")


@query("SELECT 'PARCEL_VERSION_CREATED' AS event_type, parcel_id || '-v' || version AS entity_id, role AS actor_role, parcel_id, version, status FROM cv WHERE version IS NOT NULL", _MADE)
def version_audit(p: Plan) -> DataFrame:
    return ledger.audit(ledger.created(editions(p), _requested(p))).drop("entity_type")


@query("""SELECT parcel_id || '-v' || version AS version_key, parcel_id, version, status, 0 AS n, '' AS derived_from, '' AS lineage, '' AS run_id, '' AS case_id FROM ed
  UNION ALL SELECT parcel_id || '-v' || version, parcel_id, version, status, 1, 'REVIEW', 'registration>request ' || request_id, run_id, 'RC-' || request_id FROM cv WHERE version IS NOT NULL""", _MADE)
def version_provenance(p: Plan) -> DataFrame:
    """Every version of every parcel with its provenance; versions older than the ledger have none."""
    log = editions(p)
    made = ledger.created(log, _requested(p))
    every = log.select("parcel_id", "version", "status").unionByName(made.where("version is not null").select("parcel_id", "version", "status"))
    joined = lambda field: F.array_join(F.transform("provenance", field), ";")
    return ledger.chains(every, ledger.provenance(made)).select(
        "version_key", "parcel_id", "version", "status", F.size("provenance").alias("n"), joined(lambda v: F.array_join(v["derived_from"], ",")).alias("derived_from"),
        joined(lambda v: F.array_join(v["lineage"], ">")).alias("lineage"), joined(lambda v: v["registration_run_id"]).alias("run_id"), joined(lambda v: v["review_case_id"]).alias("case_id"),
    )


def shape_text(x: Column, y: Column, arm: Column) -> Column:
    """WKT of an L at a place: a square of 20 and an arm of 20 by `arm` on its right; null without an arm."""
    at = lambda dx, dy: F.concat((x + dx).cast("string"), F.lit(" "), (y + dy).cast("string"))
    corners = [at(0, 0), at(40, 0), at(40, arm), at(20, arm), at(20, 20), at(0, 20), at(0, 0)]
    return F.when(arm.isNotNull(), F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *corners), F.lit("))")))


@query("""SELECT request_id AS action_id, parcel_id, action, CASE WHEN action IN ('APPROVE', 'REJECT') THEN 'CLOSED' ELSE 'IN_PROGRESS' END AS case_status, version, CASE WHEN makes THEN gives END AS status,
  CASE WHEN makes THEN COALESCE((SELECT arg_max(b.new_use, b.request_id) FROM am b WHERE b.parcel_id = a.parcel_id AND b.request_id <= a.request_id AND b.makes AND b.action = 'EDIT' AND b.new_use IS NOT NULL), land_use) END AS land_use,
  CASE WHEN makes THEN COALESCE((SELECT arg_max(b.new_holder, b.request_id) FROM am b WHERE b.parcel_id = a.parcel_id AND b.request_id <= a.request_id AND b.makes AND b.action = 'EDIT' AND b.new_holder IS NOT NULL), holder) END AS holder,
  CASE WHEN makes THEN COALESCE((SELECT arg_max(400 + 20 * b.arm, b.request_id) FROM am b WHERE b.parcel_id = a.parcel_id AND b.request_id <= a.request_id AND b.makes AND b.action = 'EDIT' AND b.arm IS NOT NULL), area)::DOUBLE END AS area,
  CASE WHEN makes THEN array_to_string(ds, ',') END AS sources FROM (SELECT *, CASE WHEN makes THEN last + count(*) FILTER (WHERE makes) OVER (PARTITION BY parcel_id ORDER BY request_id ROWS UNBOUNDED PRECEDING) END AS version FROM am) a""", _EDITS)
def edits_applied(p: Plan) -> DataFrame:
    """Review actions on the ledger: an edit patches attributes and geometry, and what follows goes on from there."""
    rows = p.layer("version_request").withColumn("arm", F.col("arm").cast("bigint"))
    actions = rows.select(F.col("request_id").alias("action_id"), F.concat(F.lit("RC-"), "request_id").alias("case_id"), "parcel_id", "action", "role", F.struct("land_use", "holder").alias("attributes"), shape_text(F.col("x"), F.col("y"), F.col("arm")).alias("wkt"))
    out = ledger.edited(editions(p), actions)
    return out.select("action_id", "parcel_id", "action", "case_status", "version", "status", "attributes.land_use", "attributes.holder", rings.area(F.col("ring")).alias("area"), F.array_join("source_ids", ",").alias("sources"))


@query("SELECT parcel_id, version, status, land_use FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY version DESC) AS n FROM ed WHERE 'D1' IN (dataset_1, dataset_2)) WHERE n = 1", _ED)
def editions_of_dataset(p: Plan) -> DataFrame:
    """The newest version among those that a dataset is one source of."""
    return ledger.of_dataset(editions(p), "D1").select("parcel_id", "version", "status", "attributes.land_use")


@query("""SELECT (SELECT count(*) FROM src) AS parcels, (SELECT count(*) FROM log) AS parcel_versions, (SELECT count(*) FROM mt) AS candidate_matches, (SELECT count(*) FROM cf) AS conflicts, (SELECT count(*) FROM rc) AS review_cases, (SELECT count(*) FROM obs) AS observations,
  (SELECT run_id || ' ' || status FROM run ORDER BY created_at DESC, row_id DESC LIMIT 1) AS latest_run, (SELECT string_agg(case_id, ',' ORDER BY seq DESC, case_id) FROM (SELECT case_id, CAST(substr(match_id, 3) AS BIGINT) AS seq FROM rc ORDER BY seq DESC, case_id LIMIT 10)) AS open_cases""", CASES + f", run AS ({fixtures.sql('pipeline_run', '//')})")
def desk_state(p: Plan) -> DataFrame:
    """What the desk shows first: counts of its tables, the newest run, the ten newest open cases."""
    routed = cut(p.routed())
    conflicts = governance.conflict_table(routed)
    cases = governance.review_cases(conflicts, routed)
    tables = {"parcels": p.layer("source_parcel"), "parcel_versions": p.layer("parcel_version"), "candidate_matches": routed, "conflicts": conflicts, "review_cases": cases, "observations": p.layer("observation")}
    run = p.layer("pipeline_run").agg(F.max_by(F.concat_ws(" ", "run_id", "status"), F.struct("created_at", "row_id")).alias("latest_run"))
    seq = F.substring("match_id", 3, 20).cast("bigint")
    newest = features.newest(cases.where("status = 'OPEN'").withColumn("seq", seq), 10, F.col("seq").desc(), F.col("case_id"))
    shown = newest.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("seq")).alias("s"), "case_id"))), lambda v: v["case_id"]), ",").alias("open_cases"))
    out = run.crossJoin(F.broadcast(shown))
    for name, rows in tables.items():
        out = out.crossJoin(F.broadcast(rows.agg(F.count("*").alias(name))))
    return out.select(*tables, "latest_run", "open_cases")


_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond({0}) % 1000000 <> 0 THEN strftime({0}, '.%f') ELSE '' END"


@query(f"""SELECT event_id AS id, '{{"type":"Feature","id":' || event_id || ',"geometry":null,"properties":{{"event_type":"' || event_type || '","k":' || json_extract_string(props, '$.k') || ',"ts":"' || {_ISO.format('ts')} || '","user_id":' || user_id || ',"value":' || COALESCE(CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR), 'null') || '}}}}' AS feature FROM events""")
def event_features(p: Plan) -> DataFrame:
    """Rows of any table as features: nested values beside the columns, times as ISO texts."""
    rows = p.spark.read.parquet(f"{p.sf_dir}/events.parquet")
    rows = rows.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", F.col("value").cast("decimal(18,2)").alias("value"), F.from_json("props", "k bigint").alias("props"))
    return features.row_features(rows, "event_id")
