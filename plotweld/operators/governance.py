"""The write path: matches, conflicts and review cases as tables, accepted versions with provenance and audit rows, review actions.

Every function maps tables to rows to append; ids follow from the rows they are about, so a rerun writes the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .conflicts import audit_draw
from .versions import next_versions

#: Fixed priority of conflict flags and the type each gives.
FLAGS = (
    ("geometry_invalid", "GEOMETRY_INVALID"), ("registration_failed", "REGISTRATION_FAILURE"), ("significant_overlap", "PARCEL_OVERLAP"),
    ("attribute_conflict", "ATTRIBUTE_CONFLICT"), ("ambiguous_identity", "IDENTITY_CONFLICT"), ("structural_ambiguity", "STRUCTURAL_AMBIGUITY"),
)
#: Fixed: the status each review action gives, and the actions that close a case.
ACTIONS = {"APPROVE": "APPROVED", "REJECT": "REJECTED", "FIELD_VERIFY": "FIELD_VERIFICATION", "EDIT": "CANDIDATE"}
CLOSING = ("APPROVE", "REJECT")
LINEAGE = ("registration", "candidate_match", "conflict_check", "auto_accept")
LEGACY_LINEAGE, LEGACY_MODEL = ("registration", "conflation", "auto_accept"), "matcher-1.0-logreg"


def classify() -> Column:
    """The type of the first flag that is set, null without one."""
    return F.coalesce(*(F.when(F.col(flag), kind) for flag, kind in FLAGS))


def number(parcel: str) -> Column:
    """The part of a parcel id after its layer's letter."""
    return F.substring(F.col(parcel), F.lit(3), F.length(parcel))


def match_table(decided: DataFrame) -> DataFrame:
    return decided.select(F.concat(F.lit("M-"), number("source_id")).alias("match_id"), "source_id", "targets", "relation", "probability", number("source_id").cast("bigint").alias("seq"))


def conflict_table(conflicted: DataFrame) -> DataFrame:
    """One row for each conflicted match, unresolved."""
    rows = conflicted.where("conflict_type is not null")
    parcels = F.concat(F.array("source_id"), "targets")
    return rows.select(F.concat(F.lit("CF-"), number("source_id")).alias("conflict_id"), "conflict_type", "severity", F.concat(F.lit("M-"), number("source_id")).alias("match_id"), parcels.alias("parcel_ids"), F.col("attribute_message").alias("message"), F.lit(False).alias("resolved"), number("source_id").cast("bigint").alias("seq"))


def gated(conflicts: DataFrame, gate: DataFrame) -> DataFrame:
    """Conflicts where registration passed (`gate`: one row, passed); else the one conflict of its failure."""
    failure = gate.where("not passed").select(F.lit("CF-REGISTRATION").alias("conflict_id"), F.lit("REGISTRATION_FAILURE").alias("conflict_type"), F.lit("HIGH").alias("severity"))
    open_ = conflicts.crossJoin(F.broadcast(gate)).where("passed").select("conflict_id", "conflict_type", "severity")
    return open_.unionByName(failure)


def review_cases(conflicts: DataFrame, routed: DataFrame) -> DataFrame:
    """A case for each conflict, for each unconflicted match under review, and for each audited acceptance."""
    row = lambda df, prefix, about, conflict: df.select(F.concat(F.lit(prefix), number(about)).alias("case_id"), conflict.alias("conflict_id"), F.concat(F.lit("M-"), number(about)).alias("match_id"), F.lit("OPEN").alias("status"))
    none = F.lit(None).cast("string")
    of_conflicts = row(conflicts.withColumn("about", F.col("match_id")), "RC-C-", "about", F.col("conflict_id"))
    return of_conflicts.unionByName(row(routed.where("review_case"), "RC-M-", "source_id", none)).unionByName(row(routed.where("audited"), "RC-A-", "source_id", none))


def accepted_versions(routed: DataFrame, log: DataFrame, log_id: Column, lineage: tuple[str, ...] = LINEAGE, model: str | None = None) -> DataFrame:
    """A VALIDATED version of the first target of every accepted match, numbered after the log's.

    Two acceptances of one target get numbers one after the other, by source id.
    """
    rows = routed.where("route = 'AUTO_ACCEPT'").select("source_id", F.element_at("targets", 1).alias("target_id"), "probability", log_id.alias("parcel_id"))
    base = next_versions(log)
    turn = F.row_number().over(W.partitionBy("parcel_id").orderBy("source_id"))
    out = rows.join(base, "parcel_id", "left").withColumn("version", (F.coalesce("next_version", F.lit(1)) + turn - 1).cast("bigint")).drop("next_version")
    return out.withColumns({"status": F.lit("VALIDATED"), "lineage": F.array(*map(F.lit, lineage)), "model": F.lit(model).cast("string"), "created_by_role": F.lit("SYSTEM")})


def provenance_rows(versions: DataFrame) -> DataFrame:
    """One row for each step of each version."""
    return versions.select(F.concat_ws("-v", "parcel_id", F.col("version").cast("string")).alias("version_key"), F.posexplode("lineage").alias("position", "step"), F.concat(F.lit("M-"), number("source_id")).alias("match_id"))


def audit_rows(versions: DataFrame, rate: float) -> DataFrame:
    """VERSION_CREATED for each version, AUDIT_SAMPLE for the share drawn of them."""
    key = F.concat_ws("-v", "parcel_id", F.col("version").cast("string"))
    row = lambda df, kind: df.select(F.lit(kind).alias("event_type"), F.lit("parcel_version").alias("entity_type"), key.alias("entity_id"), F.col("created_by_role").alias("actor_role"))
    return row(versions, "VERSION_CREATED").unionByName(row(versions.where(audit_draw("source_id") < int(1000 * rate)), "AUDIT_SAMPLE"))


def apply_actions(actions: DataFrame, cases: DataFrame, matches: DataFrame, log: DataFrame, log_id: Column) -> DataFrame:
    """What review actions (action_id, case_id, action, actor, attributes) do, action by action.

    A case with a match gets a new version of the match's first target, or of its source where it has none: the newest
    one with the action's status, an EDIT's attributes over the old ones. Closing actions close the case, APPROVE
    resolves its conflict. Unknown actions leave the version alone; actions on cases unknown are left out.
    """
    status = F.coalesce(*(F.when(F.col("action") == a, s) for a, s in ACTIONS.items()))
    rows = actions.join(cases, "case_id").join(matches.select("match_id", "source_id", "targets"), "match_id", "left")
    rows = rows.withColumn("target_id", F.coalesce(F.get("targets", F.lit(0)), "source_id")).withColumn("parcel_id", log_id)
    newest = log.groupBy("parcel_id").agg(F.max("version").alias("last"), F.max_by("dataset_id", "version").alias("dataset_id"))
    new = status.isNotNull() & F.col("last").isNotNull()
    turn = F.sum(F.when(new, 1).otherwise(0)).over(W.partitionBy("parcel_id").orderBy("action_id").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.join(newest, "parcel_id", "left").withColumn("version", F.when(new, (F.col("last") + turn).cast("bigint")))
    edited = F.when(F.col("action") == "EDIT", F.coalesce("attributes", F.col("dataset_id"))).otherwise(F.col("dataset_id"))
    return rows.select(
        "action_id", "case_id", "action", "parcel_id", "version", F.when(new, status).alias("new_status"), F.when(new, edited).alias("attributes"),
        F.when(F.col("action").isin(*CLOSING), "CLOSED").otherwise("IN_PROGRESS").alias("case_status"), (F.col("conflict_id").isNotNull() & (F.col("action") == "APPROVE")).alias("resolves"),
    )


def resolve(conflicts: DataFrame, applied: DataFrame, cases: DataFrame) -> DataFrame:
    """The conflicts, resolved where an action on one of their cases says so."""
    done = applied.where("resolves").join(cases.select("case_id", "conflict_id"), "case_id").select("conflict_id", F.lit(True).alias("done")).distinct()
    return conflicts.join(done, "conflict_id", "left").withColumn("resolved", F.coalesce("done", "resolved")).drop("done")
