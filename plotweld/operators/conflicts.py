"""Conflicts of matches and layers, the acceptance checklist and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RULES
from ..functions import geometry as g
from .spatial_join import distance_join, prefixed


def attribute_conflict():
    """The message of an attribute conflict, null where there is none."""
    s, t = F.col("s_revenue_area"), F.col("t_revenue_area")
    revenue = F.when(F.abs(s - t) / t > RULES.revenue_difference, "revenue area differs")
    a, b = F.upper(F.trim("s_survey_no")), F.upper(F.trim("t_survey_no"))
    number = F.when(a != b, F.when(a.contains("AMBIG") | b.contains("AMBIG"), "survey number is ambiguous").otherwise("survey number differs"))
    return F.when(revenue.isNotNull() | number.isNotNull(), F.concat_ws("; ", revenue, number))


def with_conflict(decided: DataFrame) -> DataFrame:
    """Conflict type of each decision; a later rule wins over an earlier one."""
    p, relation = F.col("probability"), F.col("relation")
    first = F.when(relation == "AMBIGUOUS", "AMBIGUOUS_MATCH").when((relation == "SPLIT") & (p < 0.75), "SPLIT_AMBIGUITY").when((relation == "MERGE") & (p < 0.75), "MERGE_AMBIGUITY")
    tested = relation.isin("ONE_TO_ONE", "BOUNDARY_ADJUSTMENT", "SPLIT", "AMBIGUOUS")
    envelope = 3 * g.relative_uncertainty(F.col("s_sigma"), F.col("t_sigma"), F.lit(RULES.registration_sigma))
    moved = tested & (F.col("centroid_distance") > envelope)
    message = F.when(tested, attribute_conflict())
    kind = F.when(moved, "PHYSICAL_EVIDENCE_CONFLICT").when(message.isNotNull(), "ATTRIBUTE_CONFLICT").otherwise(first)
    return decided.withColumn("attribute_message", message).withColumn("conflict_type", kind).withColumn("severity", F.when(kind.isNotNull(), "HIGH"))


def overlaps(layer: DataFrame) -> DataFrame:
    """Unordered pairs of one layer whose common area reaches the share of the smaller one."""
    a, b = g.box("a_"), g.box("b_")
    pairs = distance_join(prefixed(layer, "a_"), prefixed(layer, "b_"), "a_", "b_").where("a_parcel_id < b_parcel_id")
    common = g.intersection_area(a, b)
    share = common / F.least(g.area(a), g.area(b))
    return pairs.withColumn("common", common).withColumn("share", share).where(share >= RULES.overlap_share)


def checklist(rows: DataFrame) -> DataFrame:
    """The nine conditions of automatic acceptance; a missing flag counts against it.

    Registration counts as passed unless the rows carry a column `registration_passed`.
    """
    free = F.col("conflict_type").isNull()
    return rows.withColumns({
        "ok_probability": F.coalesce(F.col("probability") >= RULES.auto_match, F.lit(False)), "ok_geometry": F.coalesce(F.col("e_geometry") >= 0.5, F.lit(False)),
        "ok_registration": F.coalesce("registration_passed", F.lit(False)) if "registration_passed" in rows.columns else F.lit(True), "ok_topology": F.coalesce(g.area(g.box("t_")) >= 0.01, F.lit(False)), "ok_conflict": free,
        "ok_attribute": F.col("attribute_message").isNull(), "ok_physical": F.coalesce(F.col("conflict_type") != "PHYSICAL_EVIDENCE_CONFLICT", F.lit(True)),
        "ok_structure": ~(F.col("relation").isin("AMBIGUOUS", "SPLIT", "MERGE") & (F.col("probability") < RULES.auto_match)), "ok_target": F.size("targets") > 0,
    })


OK = ("ok_probability", "ok_geometry", "ok_registration", "ok_topology", "ok_conflict", "ok_attribute", "ok_physical", "ok_structure", "ok_target")


def audit_draw(key: str):
    """A portable draw in 0 .. 999."""
    return F.conv(F.substring(F.md5(F.col(key)), 1, 8), 16, 10).cast("bigint") % 1000


def route(rows: DataFrame) -> DataFrame:
    """AUTO_ACCEPT, or REVIEW with a case unless conflicted or unmatched; one accepted in ten is audited."""
    accept = F.col(OK[0])
    for c in OK[1:]:
        accept = accept & F.col(c)
    out = checklist(rows).withColumn("route", F.when(accept, "AUTO_ACCEPT").otherwise("REVIEW"))
    out = out.withColumn("review_case", (F.col("route") == "REVIEW") & F.col("conflict_type").isNull() & (F.col("relation") != "NO_MATCH"))
    return out.withColumn("audited", (F.col("route") == "AUTO_ACCEPT") & (audit_draw("source_id") < int(1000 * RULES.audit_rate)))
