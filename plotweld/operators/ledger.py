"""The ledger of parcel versions: requests for new ones, edits by reviewers, provenance, audit rows, chains of a parcel.

A version is a row of parcel_id, version, status, ring (x, y in metres), attributes (a struct of texts), source_ids.
Everything maps tables to rows to append. Requests and actions on one parcel take effect one after the other, by id;
a parcel's window is read in order and holds one row at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rings
from .governance import ACTIONS, CLOSING

#: Fixed: the statuses that an AI service may give.
AI_STATUSES = ("OBSERVED", "CANDIDATE", "VALIDATED", "REVIEW", "FIELD_VERIFICATION", "REJECTED")


def refusal(status: str = "status", role: str = "role") -> Column:
    """Why a request is turned down; null if it is not."""
    return F.when((F.col(role) == "AI_SERVICE") & ~F.coalesce(F.col(status).isin(*AI_STATUSES), F.lit(False)), F.concat(F.lit("AI_SERVICE cannot create status "), F.coalesce(status, F.lit("null"))))


def _so_far(order: str):
    return W.partitionBy("parcel_id").orderBy(order).rowsBetween(W.unboundedPreceding, 0)


def version_key(parcel: str = "parcel_id", version: str = "version") -> Column:
    return F.concat_ws("-v", parcel, F.col(version).cast("string"))


def created(log: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (request_id, parcel_id, status, role, ...) with their refusal and version.

    Numbers go on from the log's newest, from 1 for a parcel it lacks. A refused request takes no number.
    """
    last = log.groupBy("parcel_id").agg(F.max("version").alias("_last"))
    rows = requests.withColumn("refusal", refusal()).join(last, "parcel_id", "left")
    turn = F.sum(F.when(F.col("refusal").isNull(), 1).otherwise(0)).over(_so_far("request_id"))
    return rows.withColumn("version", F.when(F.col("refusal").isNull(), F.coalesce("_last", F.lit(0)) + turn).cast("bigint")).drop("_last")


def provenance(versions: DataFrame) -> DataFrame:
    """One row a version: what it derives from, its steps, the run, model and case behind it (null where it has no such column)."""
    optional = [F.col(c) if c in versions.columns else F.lit(None).cast("string").alias(c) for c in ("registration_run_id", "match_model", "review_case_id")]
    return versions.where("version is not null").select(version_key().alias("version_key"), F.col("source_ids").alias("derived_from"), "lineage", *optional)


def audit(versions: DataFrame) -> DataFrame:
    made = versions.where("version is not null")
    return made.select(F.lit("PARCEL_VERSION_CREATED").alias("event_type"), F.lit("parcel_version").alias("entity_type"), version_key().alias("entity_id"), F.col("role").alias("actor_role"), "parcel_id", "version", "status")


def chains(versions: DataFrame, steps: DataFrame) -> DataFrame:
    """Each version with its provenance rows, an empty array where there are none.

    `steps` are rows of provenance(); those of one version are ordered by their lineage, then by the rest.
    """
    each = F.struct("lineage", "derived_from", "registration_run_id", "match_model", "review_case_id")
    known = steps.groupBy("version_key").agg(F.array_sort(F.collect_list(each)).alias("provenance"))
    rows = versions.select("parcel_id", "version", "status", version_key().alias("version_key")).join(known, "version_key", "left")
    none = F.array().cast(known.schema["provenance"].dataType)
    return rows.withColumn("provenance", F.coalesce("provenance", none))


def edited(log: DataFrame, actions: DataFrame) -> DataFrame:
    """Versions that review actions (action_id, case_id, parcel_id, action, role, attributes, wkt) give a parcel of the log.

    An EDIT's attributes replace those of the newest version, field by field (a null leaves the field), and its wkt
    replaces the ring (a text that is no polygon of one ring leaves it). Later actions go on from there. Actions other
    than ACTIONS give no version, nor do those on parcels unknown or by an AI service beyond its statuses: their
    version is null. Fields are those of the log's attributes.
    """
    fields = log.schema["attributes"].dataType.names
    newest = log.groupBy("parcel_id").agg(F.max("version").alias("_last"), F.max_by(F.struct("ring", "attributes", "source_ids"), "version").alias("_old"))
    status = F.coalesce(*(F.when(F.col("action") == a, s) for a, s in ACTIONS.items()))
    rows = actions.withColumn("status", status).join(newest, "parcel_id", "left")
    rows = rows.withColumn("refusal", F.when(F.col("status").isNotNull(), refusal()))
    makes = F.col("status").isNotNull() & F.col("_last").isNotNull() & F.col("refusal").isNull()
    edits = makes & (F.col("action") == "EDIT")
    order = _so_far("action_id")
    kept = lambda new, old: F.coalesce(F.last(F.when(edits, new), ignorenulls=True).over(order), old)
    rows = rows.withColumns({
        "version": F.when(makes, F.col("_last") + F.sum(F.when(makes, 1).otherwise(0)).over(order)).cast("bigint"),
        "ring": kept(rings.from_wkt(F.col("wkt")), F.col("_old.ring")),
        "attributes": F.struct(*(kept(F.col(f"attributes.{f}"), F.col(f"_old.attributes.{f}")).alias(f) for f in fields)),
        "case_status": F.when(F.col("action").isin(*CLOSING), "CLOSED").otherwise("IN_PROGRESS"),
    })
    lineage = F.array(F.concat(F.lit("review_action "), "action"), F.concat(F.lit("case "), "case_id"))
    made = lambda c: F.when(F.col("version").isNotNull(), c)
    return rows.select(
        "action_id", "case_id", "parcel_id", "action", "role", "case_status", "refusal", "version", made(F.col("status")).alias("status"), made(F.col("ring")).alias("ring"),
        made(F.col("attributes")).alias("attributes"), made(F.col("_old.source_ids")).alias("source_ids"), made(lineage).alias("lineage"), F.col("case_id").alias("review_case_id"),
    )


def of_dataset(log: DataFrame, dataset: str) -> DataFrame:
    """The newest version of each parcel among those whose sources hold a dataset."""
    return log.where(F.array_contains("source_ids", dataset)).groupBy("parcel_id").agg(F.max_by(F.struct(*(c for c in log.columns if c != "parcel_id")), "version").alias("v")).select("parcel_id", "v.*")
