"""Version logs: three meanings of latest, history, governed append."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import TRANSITIONS


def latest(log: DataFrame) -> DataFrame:
    newest = W.partitionBy("parcel_id").orderBy(F.col("version").desc())
    return log.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def latest_in_dataset(log: DataFrame, dataset: str) -> DataFrame:
    """Filter first, then the newest."""
    return latest(log.where(F.col("dataset_id") == dataset))


def latest_global_filtered(log: DataFrame, dataset: str) -> DataFrame:
    """The newest of all, then keep those of the dataset."""
    return latest(log).where(F.col("dataset_id") == dataset)


def next_versions(log: DataFrame) -> DataFrame:
    return log.groupBy("parcel_id").agg((F.coalesce(F.max("version"), F.lit(0)) + 1).cast("bigint").alias("next_version"))


def violations(log: DataFrame) -> DataFrame:
    """Version rows whose status does not follow from the one before."""
    allowed = F.create_map(*chain(*((F.lit(a), F.array(*map(F.lit, b))) for a, b in TRANSITIONS.items())))
    before = F.lag("status").over(W.partitionBy("parcel_id").orderBy("version"))
    rows = log.withColumn("previous", before).where("previous is not null and previous <> status")
    return rows.where(~F.coalesce(F.array_contains(F.element_at(allowed, F.col("previous")), F.col("status")), F.lit(False)))


def governed_append(log: DataFrame, new: DataFrame, role: str) -> DataFrame:
    """New versions numbered after the log's; an AI service may not approve or publish."""
    forbidden = F.col("status").isin("APPROVED", "PUBLISHED") if role == "AI_SERVICE" else F.lit(False)
    checked = new.withColumn("status", F.when(forbidden, F.raise_error(F.lit("an AI service may not approve or publish"))).otherwise(F.col("status")))
    base = next_versions(log)
    order = W.partitionBy("parcel_id").orderBy("row_id")
    numbered = checked.join(base, "parcel_id", "left").withColumn("version", (F.coalesce("next_version", F.lit(1)) + F.row_number().over(order) - 1).cast("bigint")).drop("next_version")
    return log.unionByName(numbered, allowMissingColumns=True)
