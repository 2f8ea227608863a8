"""Ingest of layers: coordinates to the map's system, parcels if absent, first versions, datasets, assets, files of features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import projection

METRES, DEGREES = "EPSG:32643", "EPSG:4326"


def normalise(points: DataFrame, x: str = "x", y: str = "y", crs: str = "crs") -> DataFrame:
    """x and y in metres: rows in degrees are projected, rows without a system are taken as metres; other systems raise an error."""
    east, north = projection.to_utm(x, y)
    known = F.coalesce(F.col(crs), F.lit(METRES))
    pick = lambda own, moved: F.when(known == DEGREES, F.expr(moved)).when(known == METRES, F.col(own)).otherwise(F.raise_error(F.concat(F.lit("unknown coordinate system "), known)))
    return points.withColumns({x: pick(x, east).cast("double"), y: pick(y, north).cast("double"), crs: F.lit(METRES)})


def new_parcels(feed: DataFrame, parcels: DataFrame) -> DataFrame:
    """Ids of the feed that are not yet registered, each once."""
    return feed.select("parcel_id").distinct().join(parcels.select("parcel_id"), "parcel_id", "left_anti")


def first_versions(feed: DataFrame, dataset: str, status: str = "OBSERVED", keep: tuple[str, ...] = ("parcel_id", "xmin", "ymin", "xmax", "ymax")) -> DataFrame:
    """Version 1 of every feature: the area computed anew, all other columns as JSON attributes."""
    rest = [c for c in feed.columns if c not in keep]
    area = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    return feed.select("parcel_id", F.lit(1).alias("version"), F.lit(status).alias("status"), F.lit(dataset).alias("dataset_id"), area.alias("area"), F.to_json(F.struct(*rest)).alias("attributes"))


def upsert_datasets(datasets: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables' rows (dataset_id, name, ...); of one id the new row stays."""
    kept = datasets.join(new.select("dataset_id"), "dataset_id", "left_anti")
    return kept.unionByName(new)


def both_exist(datasets: DataFrame, *ids: str) -> DataFrame:
    """One row: whether all these datasets are there."""
    return datasets.agg((F.count_distinct(F.when(F.col("dataset_id").isin(*ids), F.col("dataset_id"))) == len(set(ids))).alias("ready"))


def first_assets(assets: DataFrame, *within: str) -> DataFrame:
    """The first asset of each type, by row; of each type within each value of these columns where some are named."""
    return assets.groupBy(*within, "type").agg(F.min_by(F.struct("asset_id", "path"), "row_id").alias("a")).select(*within, "type", "a.asset_id", "a.path")


def write_features(features: DataFrame, path: str, column: str = "feature") -> None:
    """One feature a line, as every task has it: no collection passes through one place."""
    features.select(column).write.mode("overwrite").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
