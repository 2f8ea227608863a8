"""Metrics of decisions against known correspondences, and of scores against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def relation_accuracy(decided: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of correct decisions by true relation, and over all: type equal and targets overlapping."""
    rows = truth.join(decided.select("source_id", "relation", "targets"), truth.legacy_id == F.col("source_id"))
    same = (F.col("relation") == F.col("relation_type")) & ((F.col("relation") == "NO_MATCH") | F.arrays_overlap("targets", "reference_ids"))
    by = rows.select("relation_type", F.coalesce(same, F.lit(False)).cast("int").alias("ok")).rollup("relation_type")
    return by.agg(F.count("*").alias("n"), F.sum("ok").cast("bigint").alias("correct"), F.round(F.avg("ok"), 6).alias("accuracy")).withColumn("relation_type", F.coalesce("relation_type", F.lit("ALL")))


def auto_accept_precision(routed: DataFrame, truth: DataFrame) -> DataFrame:
    """Accepted rows, those whose first target is a true one, and the share (0 where none is accepted)."""
    rows = routed.where("route = 'AUTO_ACCEPT'").join(truth, F.col("source_id") == F.col("legacy_id"), "left")
    good = F.coalesce(F.array_contains("reference_ids", F.col("targets")[0]), F.lit(False)).cast("int")
    return rows.agg(F.count("*").alias("accepted"), F.coalesce(F.sum(good), F.lit(0)).cast("bigint").alias("correct"), F.coalesce(F.round(F.avg(good), 6), F.lit(0.0)).alias("precision"))


def conflict_metrics(found: DataFrame, known: DataFrame) -> DataFrame:
    """Precision, recall and F1 over distinct parcel ids (recall 1 where none is known)."""
    f, k = found.select(F.col("parcel_id").alias("f")).distinct(), known.select(F.col("parcel_id").alias("k")).distinct()
    both = f.join(k, F.col("f") == F.col("k"), "full")
    counts = both.agg(F.count("f").alias("n_found"), F.count("k").alias("n_known"), F.count(F.when(F.col("f").isNotNull() & F.col("k").isNotNull(), 1)).alias("hits"))
    p = F.when(F.col("n_found") == 0, 0.0).otherwise(F.col("hits") / F.col("n_found"))
    r = F.when(F.col("n_known") == 0, 1.0).otherwise(F.col("hits") / F.col("n_known"))
    return counts.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)), 6)})


def conflict_ids(found: DataFrame, known: DataFrame) -> DataFrame:
    """Every parcel id found or known, with how it counts: hit, false alarm or missed."""
    f, k = found.select(F.col("parcel_id").alias("f")).distinct(), known.select(F.col("parcel_id").alias("k")).distinct()
    kind = F.when(F.col("k").isNull(), "false_alarm").when(F.col("f").isNull(), "missed").otherwise("hit")
    return f.join(k, F.col("f") == F.col("k"), "full").select(F.coalesce("f", "k").alias("parcel_id"), kind.alias("outcome"))


def summary(routed: DataFrame, truth: DataFrame, found: DataFrame, known: DataFrame, quality: DataFrame) -> DataFrame:
    """One row: the benchmark's figures beside their targets."""
    precision = auto_accept_precision(routed, truth).select(F.col("precision").alias("conflation_precision"))
    recall = conflict_metrics(found, known).select(F.col("recall").alias("conflict_recall"))
    effort = routed.agg(F.round(F.avg((F.col("route") == "AUTO_ACCEPT").cast("int")), 6).alias("manual_effort_reduction"), F.count(F.when((F.col("route") == "AUTO_ACCEPT") & F.col("conflict_type").isNotNull(), 1)).alias("silent_errors"))
    out = precision.crossJoin(recall).crossJoin(effort).crossJoin(quality.select(F.col("passed").alias("registration_passed"), F.round("worst_p95", 6).alias("worst_p95")))
    return out.withColumns({"precision_target": F.lit(0.95), "recall_target": F.lit(0.95), "effort_target": F.lit(0.5)})


def reliability_bins(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Mean score and share of positives of half-open bins; a score of 1 falls in none."""
    rows = scored.where("p < 1").withColumn("bin", F.floor(F.col("p") * bins).cast("int"))
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg("y"), 6).alias("share"))


def brier_and_confusion(scored: DataFrame) -> DataFrame:
    hit = F.col("p") >= 0.5
    count = lambda c: F.count(F.when(c, 1))
    c = scored.agg(F.round(F.avg((F.col("p") - F.col("y")) ** 2), 6).alias("brier"), count(hit & (F.col("y") == 1)).alias("tp"), count(hit & (F.col("y") == 0)).alias("fp"), count(~hit & (F.col("y") == 1)).alias("fn"), count(~hit & (F.col("y") == 0)).alias("tn"))
    share = lambda a, b: F.round(F.when(b == 0, 0.0).otherwise(a / b), 6)
    return c.withColumns({"accuracy": share(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), "precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn"))})
