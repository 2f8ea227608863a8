"""Registered queries of the reconciliation engine, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import conflate, conflicts, evaluate, registration, versions
from ..operators.spatial_join import distance_join, prefixed
from ..sources import fixtures
from ..sources.fixtures import layer


class Plan:
    """The stages over one input folder; frames are lazy and shared within a query."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def layer(self, name: str) -> DataFrame:
        return layer(self.spark, self.sf_dir, name)

    def pairs(self) -> DataFrame:
        return conflate.with_features(conflate.candidates(self.layer("source_parcel"), self.layer("target_parcel")))

    def scored(self, score=conflate.rule_probability) -> DataFrame:
        return score(self.pairs())

    def evidence(self, score=conflate.rule_probability) -> DataFrame:
        return conflate.with_evidence(self.scored(score), self.layer("survey_point"), conflate.building_support(self.layer("target_parcel"), self.layer("observation")))

    def decided(self, score=conflate.rule_probability, supports: bool = False) -> DataFrame:
        """Decisions; the support of points and buildings, which no rule reads, comes with them only where it is asked for."""
        rows = self.evidence(score) if supports else conflate.with_own_evidence(self.scored(score))
        return conflate.decide(self.layer("source_parcel"), rows)

    def conflicted(self, supports: bool = False) -> DataFrame:
        return conflicts.with_conflict(self.decided(supports=supports))

    def routed(self) -> DataFrame:
        return conflicts.route(self.conflicted())

    def truth(self) -> DataFrame:
        t = self.layer("target_parcel").groupBy("k").agg(F.array_sort(F.collect_list("parcel_id")).alias("reference_ids"))
        s = self.layer("source_parcel").select(F.col("parcel_id").alias("legacy_id"), F.col("k").alias("sk"))
        rows = s.join(t, F.col("sk") == F.col("k"), "left")
        kind = F.when(F.col("reference_ids").isNull(), "NO_MATCH").when(F.size("reference_ids") > 1, "SPLIT").otherwise("ONE_TO_ONE")
        return rows.select("legacy_id", F.coalesce("reference_ids", F.array().cast("array<string>")).alias("reference_ids"), kind.alias("relation_type"))


BASE = f"""
src AS ({fixtures.sql("source_parcel", "//")}), tgt AS ({fixtures.sql("target_parcel", "//")}), pts AS ({fixtures.sql("survey_point", "//")}), obs AS ({fixtures.sql("observation", "//")}),
log AS ({fixtures.sql("parcel_version", "//")}), cp AS ({fixtures.sql("control_point", "//")}), lab AS ({fixtures.sql("scored_label", "//")})"""
PAIRS = """,
cand AS (
  SELECT s.*, t.parcel_id AS t_id, t.xmin AS tx0, t.ymin AS ty0, t.xmax AS tx1, t.ymax AS ty1, t.survey_no AS t_no, t.owner_name AS t_owner, t.land_use AS t_use, t.revenue_area AS t_rev, t.sigma AS t_sigma,
    greatest(0, least(s.xmax, t.xmax) - greatest(s.xmin, t.xmin)) * greatest(0, least(s.ymax, t.ymax) - greatest(s.ymin, t.ymin)) AS inter,
    (s.xmax - s.xmin) * (s.ymax - s.ymin) AS sa, (t.xmax - t.xmin) * (t.ymax - t.ymin) AS ta, 2 * ((s.xmax - s.xmin) + (s.ymax - s.ymin)) AS sp, 2 * ((t.xmax - t.xmin) + (t.ymax - t.ymin)) AS tp,
    greatest(0, s.xmin - t.xmax, t.xmin - s.xmax) AS dx, greatest(0, s.ymin - t.ymax, t.ymin - s.ymax) AS dy
  FROM src s JOIN tgt t ON t.xmin <= s.xmax + 2 AND t.xmax >= s.xmin - 2 AND t.ymin <= s.ymax + 2 AND t.ymax >= s.ymin - 2
  WHERE sqrt(pow(greatest(0, s.xmin - t.xmax, t.xmin - s.xmax), 2) + pow(greatest(0, s.ymin - t.ymax, t.ymin - s.ymax), 2)) <= greatest(1.0::DOUBLE, 3 * sqrt(s.sigma * s.sigma + 0.3::DOUBLE * 0.3::DOUBLE))
), feat AS (
  SELECT *, inter / (sa + ta - inter) AS iou, sqrt(pow((xmin + xmax) / 2 - (tx0 + tx1) / 2, 2) + pow((ymin + ymax) / 2 - (ty0 + ty1) / 2, 2)) AS cd,
    least(sa, ta) / greatest(sa, ta) AS ar, least(sp, tp) / greatest(sp, tp) AS pr,
    least(4 * pi() * sa / (sp * sp), 4 * pi() * ta / (tp * tp)) / greatest(4 * pi() * sa / (sp * sp), 4 * pi() * ta / (tp * tp)) AS sh,
    ((lower(trim(survey_no)) = lower(trim(t_no)))::INT::DOUBLE + (lower(trim(owner_name)) = lower(trim(t_owner)))::INT::DOUBLE + (lower(trim(land_use)) = lower(trim(t_use)))::INT::DOUBLE + (1 - abs(revenue_area - t_rev) / greatest(revenue_area, t_rev))) / 4 AS att,
    CASE WHEN upper(survey_no) = upper(t_no) THEN 1.0 WHEN contains(upper(survey_no), 'AMBIG') OR contains(upper(t_no), 'AMBIG') THEN 0.2 WHEN replace(upper(survey_no), '_X', '') = replace(upper(t_no), '_X', '') THEN 0.7 ELSE 0.3 END::DOUBLE AS ident
  FROM cand
), sc AS (SELECT *, round(0.7::DOUBLE * iou + 0.2::DOUBLE * att + 0.1::DOUBLE * ident, 4) AS p FROM feat)"""
EVIDENCE = PAIRS + """,
zone AS (
  SELECT parcel_id, t_id, CASE WHEN least(xmax, tx1) > greatest(xmin, tx0) AND least(ymax, ty1) > greatest(ymin, ty0) THEN [greatest(xmin, tx0), greatest(ymin, ty0), least(xmax, tx1), least(ymax, ty1), 1.01::DOUBLE] ELSE [xmin, ymin, xmax, ymax, 1.0::DOUBLE] END AS z FROM cand
), gn AS (
  SELECT z.parcel_id, z.t_id, count(*) AS n FROM zone z JOIN pts ON x >= z[1] - 2 AND x <= z[3] + 2 AND y >= z[2] - 2 AND y <= z[4] + 2
  WHERE sqrt(pow(greatest(0, z[1] - x, x - z[3]), 2) + pow(greatest(0, z[2] - y, y - z[4]), 2)) <= z[5] GROUP BY ALL
), bu AS (
  SELECT t.parcel_id AS t_id, count(*) AS n FROM tgt t JOIN obs o ON o.type IN ('BUILDING', 'BUILDING_EDGE', 'WALL') AND o.xmin <= t.xmax AND o.xmax >= t.xmin AND o.ymin <= t.ymax AND o.ymax >= t.ymin GROUP BY ALL
), ev AS (
  SELECT sc.*, COALESCE(gn.n, 0) AS n_gnss, COALESCE(bu.n, 0) AS n_bu, round(0.5::DOUBLE * iou + 0.25::DOUBLE * ar + 0.25::DOUBLE * sh, 4) AS e_geo, round(att, 4) AS e_att,
    round(least(1, COALESCE(gn.n, 0) / 3), 4) AS e_sur, round(least(1, COALESCE(bu.n, 0) / 2), 4) AS e_phy
  FROM sc LEFT JOIN gn USING (parcel_id, t_id) LEFT JOIN bu USING (t_id)
)"""
DECIDED = EVIDENCE + """,
rk AS (
  SELECT *, row_number() OVER w AS r, COALESCE(lead(p) OVER w, 0) AS second FROM ev WINDOW w AS (PARTITION BY parcel_id ORDER BY p DESC, t_id)
), hi AS (
  SELECT parcel_id, count(*) AS n, list(t_id ORDER BY r) AS ids, avg(p) AS mean_p, bool_and(inter / ta >= 0.5) AS child, sum(inter) / min(sa) AS cover, abs(1 - sum(ta) / min(sa)) AS off FROM rk WHERE p >= 0.6 AND r <= 4 GROUP BY parcel_id
), ov AS (
  SELECT a.parcel_id, max(greatest(0, least(a.tx1, b.tx1) - greatest(a.tx0, b.tx0)) * greatest(0, least(a.ty1, b.ty1) - greatest(a.ty0, b.ty0)) / least(a.ta, b.ta)) AS worst
  FROM rk a JOIN rk b ON a.parcel_id = b.parcel_id AND a.r < b.r AND a.p >= 0.6 AND b.p >= 0.6 AND b.r <= 4 GROUP BY a.parcel_id
), de0 AS (
  SELECT s.parcel_id AS source_id, rk.* EXCLUDE (parcel_id), ids, mean_p, COALESCE(hi.n, 0) >= 2 AND NOT (p >= 0.7 AND p - second >= 0.08::DOUBLE) AS contested,
    child AND cover >= 0.85 AND worst <= 0.1 AND off <= 0.15 AS split, iou >= 0.7 AND cd <= 5 AND abs(sa - ta) / greatest(sa, ta) < 0.25 AS adj
  FROM src s LEFT JOIN rk ON rk.parcel_id = s.parcel_id AND rk.r = 1 LEFT JOIN hi ON hi.parcel_id = s.parcel_id LEFT JOIN ov ON ov.parcel_id = s.parcel_id
), de1 AS (
  SELECT *, CASE WHEN p IS NULL THEN 'NO_MATCH' WHEN contested AND split THEN 'SPLIT' WHEN contested AND p >= 0.75 AND iou >= 0.55 THEN CASE WHEN adj THEN 'BOUNDARY_ADJUSTMENT' ELSE 'ONE_TO_ONE' END
    WHEN contested THEN 'AMBIGUOUS' WHEN adj AND p >= 0.7 THEN 'BOUNDARY_ADJUSTMENT' WHEN p < 0.45 THEN 'NO_MATCH' ELSE 'ONE_TO_ONE' END AS relation FROM de0
), de AS (
  SELECT *, CASE relation WHEN 'SPLIT' THEN ids WHEN 'AMBIGUOUS' THEN ids[1:3] WHEN 'NO_MATCH' THEN [] ELSE [t_id] END AS targets, CASE WHEN relation = 'SPLIT' THEN round(mean_p, 4) ELSE COALESCE(p, 0) END AS probability FROM de1
), co0 AS (
  SELECT *, relation <> 'NO_MATCH' AND cd > 3 * sqrt(sigma * sigma + t_sigma * t_sigma + 0.3::DOUBLE * 0.3::DOUBLE) AS moved, CASE WHEN relation <> 'NO_MATCH' THEN NULLIF(concat_ws('; ', CASE WHEN abs(revenue_area - t_rev) / t_rev > 0.15 THEN 'revenue area differs' END,
    CASE WHEN upper(trim(survey_no)) <> upper(trim(t_no)) THEN CASE WHEN contains(upper(survey_no), 'AMBIG') OR contains(upper(t_no), 'AMBIG') THEN 'survey number is ambiguous' ELSE 'survey number differs' END END), '') END AS msg FROM de
), co AS (
  SELECT *, CASE WHEN moved THEN 'PHYSICAL_EVIDENCE_CONFLICT' WHEN msg IS NOT NULL THEN 'ATTRIBUTE_CONFLICT' WHEN relation = 'AMBIGUOUS' THEN 'AMBIGUOUS_MATCH' WHEN relation = 'SPLIT' AND probability < 0.75 THEN 'SPLIT_AMBIGUITY' END AS conflict_type FROM co0
), ro AS (
  SELECT *, CASE WHEN probability >= 0.9 AND COALESCE(e_geo, 0) >= 0.5 AND COALESCE(ta, 0) >= 0.01 AND conflict_type IS NULL AND msg IS NULL AND NOT (relation IN ('AMBIGUOUS', 'SPLIT') AND probability < 0.9) AND len(targets) > 0 THEN 'AUTO_ACCEPT' ELSE 'REVIEW' END AS route FROM co
)"""
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None, ctes: str = ""):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Plan(spark, sf_dir))
        QUERIES[f.__name__].__name__ = f.__name__
        if sql:
            ORACLE[f.__name__] = f"WITH RECURSIVE {BASE}{ctes}\n{sql}"
        return f

    return add


LATEST = "SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY version DESC) AS n FROM"


@query("SELECT source_id, t_id AS target_id, iou, p FROM (SELECT s.parcel_id AS source_id, f.t_id, f.iou, f.p, row_number() OVER (PARTITION BY s.parcel_id ORDER BY f.iou DESC, f.t_id) AS n FROM src s LEFT JOIN sc f ON f.parcel_id = s.parcel_id) WHERE n = 1", PAIRS)
def best_match_ranked(p: Plan) -> DataFrame:
    first = W.partitionBy("s_parcel_id").orderBy(F.col("iou").desc(), "t_parcel_id")
    best = p.scored().select("s_parcel_id", F.col("t_parcel_id").alias("target_id"), "iou", "p", F.row_number().over(first).alias("n")).where("n = 1")
    s = p.layer("source_parcel").select(F.col("parcel_id").alias("source_id"))
    return s.join(best, F.col("source_id") == F.col("s_parcel_id"), "left").select("source_id", "target_id", "iou", "p")


@query(f"SELECT parcel_id, version, status, area FROM ({LATEST} log WHERE dataset_id = 'D1') WHERE n = 1")
def latest_in_dataset(p: Plan) -> DataFrame:
    return versions.latest_in_dataset(p.layer("parcel_version"), "D1").select("parcel_id", "version", "status", "area")


@query(f"SELECT parcel_id, version, status, area FROM ({LATEST} log) WHERE n = 1 AND dataset_id = 'D1'")
def latest_global_filtered(p: Plan) -> DataFrame:
    return versions.latest_global_filtered(p.layer("parcel_version"), "D1").select("parcel_id", "version", "status", "area")


@query("SELECT s.parcel_id AS source_id, l.parcel_id, max(l.version) AS version FROM cand s JOIN log l ON l.parcel_id = concat('P-', split_part(s.t_id, '-', 2)) AND l.dataset_id = 'D1' GROUP BY ALL", PAIRS)
def latest_among_hits(p: Plan) -> DataFrame:
    hits = conflate.candidates(p.layer("source_parcel"), p.layer("target_parcel")).select(F.col("s_parcel_id").alias("source_id"), F.concat(F.lit("P-"), F.split("t_parcel_id", "-")[1]).alias("hit"))
    log = p.layer("parcel_version").where("dataset_id = 'D1'")
    return hits.join(log, F.col("hit") == F.col("parcel_id")).groupBy("source_id", "parcel_id").agg(F.max("version").alias("version"))


@query("SELECT parcel_id, version, status, dataset_id, created_at FROM log WHERE parcel_id IN ('P-1', 'P-4', 'P-7') ")
def version_history(p: Plan) -> DataFrame:
    return p.layer("parcel_version").where(F.col("parcel_id").isin("P-1", "P-4", "P-7")).select("parcel_id", "version", "status", "dataset_id", "created_at")


@query("SELECT parcel_id, COALESCE(max(version), 0) + 1 AS next_version FROM log GROUP BY 1")
def next_version(p: Plan) -> DataFrame:
    return versions.next_versions(p.layer("parcel_version"))


@query(f"SELECT parcel_id, version, dataset_id FROM ({LATEST} log WHERE version >= 2 AND status = 'CANDIDATE') WHERE n = 1")
def registered_parcels(p: Plan) -> DataFrame:
    return versions.latest(p.layer("parcel_version").where("version >= 2 and status = 'CANDIDATE'")).select("parcel_id", "version", "dataset_id")


@query("SELECT parcel_id, version, previous, status FROM (SELECT *, lag(status) OVER (PARTITION BY parcel_id ORDER BY version) AS previous FROM log) WHERE previous <> status AND NOT (previous = 'OBSERVED' AND status = 'CANDIDATE') AND NOT (previous = 'CANDIDATE' AND status = 'VALIDATED')")
def state_machine_violations(p: Plan) -> DataFrame:
    return versions.violations(p.layer("parcel_version")).select("parcel_id", "version", "previous", "status")


@query("SELECT parcel_id, count(*) AS n, list_sort(list(DISTINCT dataset_id)) AS datasets, list(version ORDER BY version) AS lineage FROM log GROUP BY 1")
def provenance_chain(p: Plan) -> DataFrame:
    return p.layer("parcel_version").groupBy("parcel_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("dataset_id")).alias("datasets"), F.array_sort(F.collect_list("version")).alias("lineage"))


@query("SELECT min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM (SELECT xmin, ymin, xmax, ymax FROM src UNION ALL SELECT xmin, ymin, xmax, ymax FROM tgt)")
def layer_extent(p: Plan) -> DataFrame:
    cols = ("xmin", "ymin", "xmax", "ymax")
    both = p.layer("source_parcel").select(*cols).unionByName(p.layer("target_parcel").select(*cols))
    return both.agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


@query("SELECT 'source_parcel' AS name, count(*) AS n FROM src UNION ALL SELECT 'target_parcel', count(*) FROM tgt UNION ALL SELECT 'survey_point', count(*) FROM pts UNION ALL SELECT 'observation', count(*) FROM obs UNION ALL SELECT 'parcel_version', count(*) FROM log")
def state_counts(p: Plan) -> DataFrame:
    out = None
    for name in ("source_parcel", "target_parcel", "survey_point", "observation", "parcel_version"):
        row = p.layer(name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT parcel_id, version, created_at FROM log ORDER BY created_at DESC, row_id LIMIT 20")
def newest_versions(p: Plan) -> DataFrame:
    return p.layer("parcel_version").orderBy(F.col("created_at").desc(), "row_id").limit(20).select("parcel_id", "version", "created_at")


@query("SELECT parcel_id, xmin, ymin, xmax, ymax FROM tgt WHERE xmin <= 500900 AND xmax >= 500100 AND ymin <= 3000400 AND ymax >= 3000000 ORDER BY parcel_id LIMIT 50 OFFSET 20")
def items_bbox_page(p: Plan) -> DataFrame:
    hit = p.layer("target_parcel").where("xmin <= 500900 and xmax >= 500100 and ymin <= 3000400 and ymax >= 3000000")
    return hit.orderBy("parcel_id").offset(20).limit(50).select("parcel_id", "xmin", "ymin", "xmax", "ymax")


@query("SELECT status, dataset_id, count(*) AS matched FROM log GROUP BY 1, 2")
def items_filtered_count(p: Plan) -> DataFrame:
    return p.layer("parcel_version").groupBy("status", "dataset_id").agg(F.count("*").alias("matched"))


@query("SELECT parcel_id, (xmax - xmin) * (ymax - ymin) AS area, 2 * ((xmax - xmin) + (ymax - ymin)) AS perimeter, (xmin + xmax) / 2 AS cx, (ymin + ymax) / 2 AS cy, round(4 * pi() * (xmax - xmin) * (ymax - ymin) / pow(2 * ((xmax - xmin) + (ymax - ymin)), 2), 6) AS compactness FROM tgt")
def ring_measures(p: Plan) -> DataFrame:
    b = g.box()
    cx, cy = g.centroid(b)
    return p.layer("target_parcel").select("parcel_id", g.area(b).alias("area"), g.perimeter(b).alias("perimeter"), cx.alias("cx"), cy.alias("cy"), F.round(g.compactness(b), 6).alias("compactness"))


@query("SELECT parcel_id AS source_id, t_id AS target_id, sqrt(dx * dx + dy * dy) AS distance FROM cand", PAIRS)
def candidate_pairs(p: Plan) -> DataFrame:
    rows = conflate.candidates(p.layer("source_parcel"), p.layer("target_parcel"))
    return rows.select(F.col("s_parcel_id").alias("source_id"), F.col("t_parcel_id").alias("target_id"), g.distance(g.box("s_"), g.box("t_")).alias("distance"))


@query("SELECT parcel_id AS source_id, t_id AS target_id, iou, round(cd, 9) AS centroid_distance, ar AS area_ratio, pr AS perimeter_ratio, round(sh, 9) AS shape_similarity FROM feat", PAIRS)
def pair_features_box(p: Plan) -> DataFrame:
    return p.pairs().select(F.col("s_parcel_id").alias("source_id"), F.col("t_parcel_id").alias("target_id"), "iou", F.round("centroid_distance", 9).alias("centroid_distance"), "area_ratio", "perimeter_ratio", F.round("shape_similarity", 9).alias("shape_similarity"))


@query("""SELECT source_id, target_id, round(max(d), 9) AS hausdorff FROM (
  SELECT source_id, target_id, CASE WHEN least(x - a, c - x, y - b, e - y) >= 0 THEN least(x - a, c - x, y - b, e - y) ELSE sqrt(pow(greatest(a - x, 0, x - c), 2) + pow(greatest(b - y, 0, y - e), 2)) END AS d FROM (
    SELECT parcel_id AS source_id, t_id AS target_id, unnest([xmin, xmin, xmax, xmax]) AS x, unnest([ymin, ymax, ymin, ymax]) AS y, tx0 AS a, ty0 AS b, tx1 AS c, ty1 AS e FROM cand
    UNION ALL SELECT parcel_id, t_id, unnest([tx0, tx0, tx1, tx1]), unnest([ty0, ty1, ty0, ty1]), xmin, ymin, xmax, ymax FROM cand)) GROUP BY 1, 2""", PAIRS)
def hausdorff_box(p: Plan) -> DataFrame:
    return p.pairs().select(F.col("s_parcel_id").alias("source_id"), F.col("t_parcel_id").alias("target_id"), F.round("hausdorff", 9).alias("hausdorff"))


@query("SELECT parcel_id AS source_id, t_id AS target_id, round(att, 6) AS attribute_similarity, ident AS identity FROM feat", PAIRS)
def attribute_similarity(p: Plan) -> DataFrame:
    return p.pairs().select(F.col("s_parcel_id").alias("source_id"), F.col("t_parcel_id").alias("target_id"), F.round("attribute_similarity", 6).alias("attribute_similarity"), "identity")


@query("SELECT ident AS identity, count(*) AS n FROM feat GROUP BY 1", PAIRS)
def identity_ladder(p: Plan) -> DataFrame:
    return p.pairs().groupBy("identity").agg(F.count("*").alias("n"))


@query("SELECT parcel_id AS source_id, t_id AS target_id, n_gnss FROM ev WHERE n_gnss > 0", EVIDENCE)
def gnss_support(p: Plan) -> DataFrame:
    rows = conflate.gnss_support(conflate.candidates(p.layer("source_parcel"), p.layer("target_parcel")), p.layer("survey_point"))
    return rows.select(F.col("s_parcel_id").alias("source_id"), F.col("t_parcel_id").alias("target_id"), "n_gnss")


@query("SELECT t_id AS target_id, n AS n_buildings FROM bu", EVIDENCE)
def building_support(p: Plan) -> DataFrame:
    return conflate.building_support(p.layer("target_parcel"), p.layer("observation")).select(F.col("t_parcel_id").alias("target_id"), "n_buildings")


@query("SELECT parcel_id AS source_id, t_id AS target_id, e_geo AS geometry, e_att AS attribute, e_sur AS survey, e_phy AS physical, 0.9::DOUBLE AS temporal, ident AS identity FROM ev", EVIDENCE)
def six_dim_evidence(p: Plan) -> DataFrame:
    return p.evidence().select(F.col("s_parcel_id").alias("source_id"), F.col("t_parcel_id").alias("target_id"), *(F.col(f"e_{d}").alias(d) for d in ("geometry", "attribute", "survey", "physical", "temporal", "identity")))


FUSED = "round((6 * e_sur + 5 * e_geo + 4 * e_phy + 3 * ident + 2 * e_att + 0.9::DOUBLE) / 21, 4)"


@query(f"SELECT parcel_id AS source_id, t_id AS target_id, {FUSED} AS fusion_score, abs((e_sur + e_geo + e_phy) / 3 - (e_att + 0.9::DOUBLE + ident) / 3) > 0.3 AS disagreement FROM ev", EVIDENCE)
def fused_evidence(p: Plan) -> DataFrame:
    return conflate.fuse(p.evidence()).select(F.col("s_parcel_id").alias("source_id"), F.col("t_parcel_id").alias("target_id"), "fusion_score", "disagreement")


@query("SELECT relation, count(*) AS n, round(avg(e_geo), 6) AS geometry, round(avg(e_att), 6) AS attribute, round(avg(probability), 6) AS probability FROM de GROUP BY 1", DECIDED)
def fusion_means_by_relation(p: Plan) -> DataFrame:
    return p.decided().groupBy("relation").agg(F.count("*").alias("n"), F.round(F.avg("e_geometry"), 6).alias("geometry"), F.round(F.avg("e_attribute"), 6).alias("attribute"), F.round(F.avg("probability"), 6).alias("probability"))


@query("SELECT source_id, relation, probability, array_to_string(targets, ',') AS targets FROM de", DECIDED)
def relation_decision(p: Plan) -> DataFrame:
    return p.decided().select("source_id", "relation", "probability", F.array_join("targets", ",").alias("targets"))


@query("""SELECT target_id, array_to_string(list_sort(list(source_id)), ',') AS sources, 'MERGE' AS relation, 0.85::DOUBLE AS probability FROM (SELECT targets[1] AS target_id, * FROM de WHERE relation IN ('ONE_TO_ONE', 'BOUNDARY_ADJUSTMENT')) GROUP BY target_id
  HAVING count(*) >= 2 AND min(inter / sa) >= 0.5 AND sum(inter) / min(ta) >= 0.85 AND abs(1 - sum(sa) / min(ta)) <= 0.15""", DECIDED)
def merge_detect(p: Plan) -> DataFrame:
    return conflate.merges(p.decided(), p.layer("source_parcel"), p.layer("target_parcel")).select("target_id", F.array_join("sources", ",").alias("sources"), "relation", "probability")


@query("SELECT source_id, relation, conflict_type, msg AS message, 'HIGH' AS severity FROM co WHERE conflict_type IS NOT NULL", DECIDED)
def conflict_rows(p: Plan) -> DataFrame:
    return p.conflicted().where("conflict_type is not null").select("source_id", "relation", "conflict_type", F.col("attribute_message").alias("message"), "severity")


@query("""SELECT a.parcel_id AS a, b.parcel_id AS b, c AS common FROM (SELECT a, b, greatest(0, least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * greatest(0, least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin)) AS c FROM src a JOIN src b ON a.parcel_id < b.parcel_id AND a.xmin < b.xmax AND b.xmin < a.xmax AND a.ymin < b.ymax AND b.ymin < a.ymax)
  WHERE c / least((a.xmax - a.xmin) * (a.ymax - a.ymin), (b.xmax - b.xmin) * (b.ymax - b.ymin)) >= 0.05""")
def overlap_conflicts(p: Plan) -> DataFrame:
    return conflicts.overlaps(p.layer("source_parcel")).select(F.col("a_parcel_id").alias("a"), F.col("b_parcel_id").alias("b"), "common")


@query("SELECT source_id, relation, route, route = 'REVIEW' AND conflict_type IS NULL AND relation <> 'NO_MATCH' AS review_case, route = 'AUTO_ACCEPT' AND CAST('0x' || substr(md5(source_id), 1, 8) AS BIGINT) % 1000 < 100 AS audited FROM ro", DECIDED)
def route_candidates(p: Plan) -> DataFrame:
    return p.routed().select("source_id", "relation", "route", "review_case", "audited")


@query("""SELECT user_id, n AS n_actions, max_by(CASE event_type WHEN 'purchase' THEN 'APPROVED' WHEN 'error' THEN 'REJECTED' WHEN 'view' THEN 'FIELD_VERIFICATION' ELSE 'CANDIDATE' END, {'ts': ts, 'id': event_id}) AS status
  FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type IN ('purchase', 'error', 'view', 'signup')) GROUP BY 1, 2""")
def review_actions_applied(p: Plan) -> DataFrame:
    e = p.spark.read.parquet(f"{p.sf_dir}/events.parquet").where(F.col("event_type").isin("purchase", "error", "view", "signup"))
    t = F.col("event_type")
    status = F.when(t == "purchase", "APPROVED").when(t == "error", "REJECTED").when(t == "view", "FIELD_VERIFICATION").otherwise("CANDIDATE")
    return e.groupBy("user_id").agg(F.count("*").alias("n_actions"), F.max_by(status, F.struct("ts", "event_id")).alias("status"))


@query("""SELECT source_id, t_id AS target_id, (xmin + xmax) / 2 AS x0, (ymin + ymax) / 2 AS y0, (tx0 + tx1) / 2 AS x1, (ty0 + ty1) / 2 AS y1 FROM de WHERE len(targets) > 0""", DECIDED)
def match_links(p: Plan) -> DataFrame:
    (sx, sy), (tx, ty) = g.centroid(g.box("s_")), g.centroid(g.box("t_"))
    return p.decided().where(F.size("targets") > 0).select("source_id", F.col("t_parcel_id").alias("target_id"), sx.alias("x0"), sy.alias("y0"), tx.alias("x1"), ty.alias("y1"))


FIT = """,
m AS (SELECT avg(sx) AS mx, avg(sy) AS my, avg(tx) AS mu, avg(ty) AS mv FROM cp), q AS (
  SELECT sum((sx - mx) ** 2) AS xx, sum((sx - mx) * (sy - my)) AS xy, sum((sy - my) ** 2) AS yy, sum((sx - mx) * (tx - mu)) AS xu, sum((sy - my) * (tx - mu)) AS yu, sum((sx - mx) * (ty - mv)) AS xv, sum((sy - my) * (ty - mv)) AS yv FROM cp, m
), f0 AS (SELECT (xu * yy - yu * xy) / (xx * yy - xy * xy) AS a, (xx * yu - xy * xu) / (xx * yy - xy * xy) AS b, (xv * yy - yv * xy) / (xx * yy - xy * xy) AS c, (xx * yv - xy * xv) / (xx * yy - xy * xy) AS d FROM q),
fit AS (SELECT a, b, mu - a * mx - b * my AS e, c, d, mv - c * mx - d * my AS f FROM f0, m),
res AS (SELECT point_id, sx, sy, a * sx + b * sy + e AS px, c * sx + d * sy + f AS py, sqrt((a * sx + b * sy + e - tx) ** 2 + (c * sx + d * sy + f - ty) ** 2) AS r FROM cp, fit),
ext AS (SELECT min(sx) AS x0, max(sx) AS x1, min(sy) AS y0, max(sy) AS y1 FROM cp),
reg AS (SELECT res.*, least(floor((sy - y0) / greatest(y1 - y0, 1e-9) * 3), 2)::INT AS row, least(floor((sx - x0) / greatest(x1 - x0, 1e-9) * 3), 2)::INT AS col FROM res, ext)"""


@query("SELECT round(a, 6) AS a, round(b, 6) AS b, round(e, 6) AS e, round(c, 6) AS c, round(d, 6) AS d, round(f, 6) AS f FROM fit", FIT)
def affine_fit(p: Plan) -> DataFrame:
    return registration.affine(p.layer("control_point")).select(*(F.round(c, 6).alias(c) for c in "abecdf"))


@query("""SELECT round(scale, 6) AS scale, round(rot, 6) AS rotation, round(mu - (scale * cos(rot) * mx - scale * sin(rot) * my), 5) AS shift_x, round(mv - (scale * sin(rot) * mx + scale * cos(rot) * my), 5) AS shift_y FROM (
  SELECT sqrt(sum((tx - mu) ** 2 + (ty - mv) ** 2) / sum((sx - mx) ** 2 + (sy - my) ** 2)) AS scale, atan2(sum(((ty - mv) * (sx - mx) - (tx - mu) * (sy - my)) / ((sx - mx) ** 2 + (sy - my) ** 2)), sum(((tx - mu) * (sx - mx) + (ty - mv) * (sy - my)) / ((sx - mx) ** 2 + (sy - my) ** 2))) AS rot FROM cp, m), m""", FIT)
def helmert_fit(p: Plan) -> DataFrame:
    return registration.helmert(p.layer("control_point")).select(F.round("scale", 6).alias("scale"), F.round("rotation", 6).alias("rotation"), F.round("shift_x", 5).alias("shift_x"), F.round("shift_y", 5).alias("shift_y"))


def _residuals(p: Plan) -> DataFrame:
    points = p.layer("control_point")
    return registration.with_region(registration.with_residual(registration.apply_affine(points, registration.affine(points))))


@query("SELECT point_id, round(px, 6) AS px, round(py, 6) AS py, concat('r', row, 'c', col) AS region FROM reg", FIT)
def apply_affine(p: Plan) -> DataFrame:
    return _residuals(p).select("point_id", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"), "region")


@query("SELECT concat('r', row, 'c', col) AS region, count(*) AS n, round(sqrt(avg(r * r)), 6) AS rmse, round(quantile_cont(r, 0.5), 6) AS p50, round(quantile_cont(r, 0.95), 6) AS p95, round(max(r), 6) AS max FROM reg GROUP BY 1", FIT)
def residual_stats(p: Plan) -> DataFrame:
    return registration.regional_stats(_residuals(p)).select("region", "n", *(F.round(c, 6).alias(c) for c in ("rmse", "p50", "p95", "max")))


@query("SELECT g.row::INT AS row, h.col::INT AS col, count(r) AS n, round(avg(r), 6) AS mean, round(quantile_cont(r, 0.95), 6) AS p95 FROM range(3) g(row), range(3) h(col) LEFT JOIN reg ON reg.row = g.row AND reg.col = h.col GROUP BY 1, 2", FIT)
def residual_heatmap(p: Plan) -> DataFrame:
    return registration.heatmap(_residuals(p)).select("row", "col", "n", F.round("mean", 6).alias("mean"), F.round("p95", 6).alias("p95"))


TRUTH = """,
tr AS (SELECT s.parcel_id AS legacy_id, list(t.parcel_id) FILTER (WHERE t.parcel_id IS NOT NULL) AS refs FROM src s LEFT JOIN tgt t ON t.k = s.k GROUP BY 1),
tk AS (SELECT *, CASE WHEN refs IS NULL OR len(refs) = 0 THEN 'NO_MATCH' WHEN len(refs) > 1 THEN 'SPLIT' ELSE 'ONE_TO_ONE' END AS relation_type FROM tr)"""


@query("SELECT COALESCE(relation_type, 'ALL') AS relation_type, count(*) AS n, sum(ok)::BIGINT AS correct, round(avg(ok), 6) AS accuracy FROM (SELECT relation_type, COALESCE(relation = relation_type AND (relation = 'NO_MATCH' OR list_has_any(targets, refs)), false)::INT AS ok FROM tk JOIN de ON source_id = legacy_id) GROUP BY ROLLUP (relation_type)", DECIDED + TRUTH)
def relation_accuracy(p: Plan) -> DataFrame:
    return evaluate.relation_accuracy(p.decided(), p.truth())


@query("SELECT count(*) AS accepted, COALESCE(sum(ok), 0)::BIGINT AS correct, COALESCE(round(avg(ok), 6), 0) AS precision FROM (SELECT COALESCE(list_contains(refs, targets[1]), false)::INT AS ok FROM ro LEFT JOIN tk ON source_id = legacy_id WHERE route = 'AUTO_ACCEPT')", DECIDED + TRUTH)
def conflation_precision(p: Plan) -> DataFrame:
    return evaluate.auto_accept_precision(p.routed(), p.truth())


@query("""SELECT f AS n_found, k AS n_known, h AS hits, round(h / f, 6) AS precision, round(h / k, 6) AS recall, round(2 * (h / f) * (h / k) / (h / f + h / k), 6) AS f1 FROM (
  SELECT (SELECT count(*) FROM co WHERE conflict_type = 'ATTRIBUTE_CONFLICT') AS f, (SELECT count(*) FROM src WHERE k % 31 = 4 OR k % 29 = 3 OR k % 23 = 5) AS k,
    (SELECT count(*) FROM co WHERE conflict_type = 'ATTRIBUTE_CONFLICT' AND source_id IN (SELECT parcel_id FROM src WHERE k % 31 = 4 OR k % 29 = 3 OR k % 23 = 5)) AS h)""", DECIDED)
def conflict_metrics(p: Plan) -> DataFrame:
    found = p.conflicted().where("conflict_type = 'ATTRIBUTE_CONFLICT'").select(F.col("source_id").alias("parcel_id"))
    return evaluate.conflict_metrics(found, p.layer("source_parcel").where("k % 31 = 4 or k % 29 = 3 or k % 23 = 5"))


@query("SELECT floor(p * 10)::INT AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS share FROM lab WHERE p < 1 GROUP BY 1")
def reliability_bins(p: Plan) -> DataFrame:
    return evaluate.reliability_bins(p.layer("scored_label"))


@query("SELECT brier, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM (SELECT round(avg((p - y) ** 2), 6) AS brier, count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn, count(*) FILTER (WHERE p < 0.5 AND y = 0) AS tn FROM lab)")
def brier_and_confusion(p: Plan) -> DataFrame:
    return evaluate.brier_and_confusion(p.layer("scored_label"))


@query("SELECT point_id, kind FROM (SELECT p.point_id, CASE WHEN count(o.obs_id) > 0 THEN 'near' ELSE 'free' END AS kind FROM pts p LEFT JOIN obs o ON p.x >= o.xmin - 5 AND p.x <= o.xmax + 5 AND p.y >= o.ymin - 5 AND p.y <= o.ymax + 5 AND sqrt(pow(greatest(0, o.xmin - p.x, p.x - o.xmax), 2) + pow(greatest(0, o.ymin - p.y, p.y - o.ymax), 2)) <= 5 GROUP BY 1)")
def points_near_observations(p: Plan) -> DataFrame:
    pts = p.layer("survey_point")
    spots = pts.select(F.col("point_id").alias("p_id"), *(F.col(c).alias(f"p_{n}") for c, n in (("x", "xmin"), ("y", "ymin"), ("x", "xmax"), ("y", "ymax"))))
    near = distance_join(spots, prefixed(p.layer("observation"), "o_"), "p_", "o_", 5.0).select("p_id").distinct()
    return pts.select("point_id").join(near, F.col("point_id") == F.col("p_id"), "left").select("point_id", F.when(F.col("p_id").isNotNull(), "near").otherwise("free").alias("kind"))
