"""The evidence stage: what the images of a dataset show, and stand-ins drawn from the parcels where they show nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rings
from ..sources.ingest import first_assets
from . import versions
from .spatial_join import prefixed
from .uneven_join import uneven_join

# Fixed values of the stand-ins: metres, square metres, shares, and lowest and highest figures.
LEAST_PARCEL, INSET, LEAST_INSET, LEAST_BUILDING, LEAST_WALL = 100.0, 3.0, 10.0, 5.0, 2.0
WALL_SHARE = 0.6
SIDE, PLACE, HEIGHT = (0.3, 0.6), (0.1, 0.9), (5.0, 12.0)
CONFIDENCE = {"BUILDING": (0.85, 0.97), "WALL": (0.80, 0.93)}
UNCERTAINTY = {"BUILDING": (0.12, 0.25), "WALL": (0.10, 0.20)}
FROM_IMAGES, STAND_IN = "image-extraction-v2", "synthetic-v1"

BOUNDS = ("x0", "y0", "x1", "y1")
COLUMNS = ["obs_id", "dataset_id", "type", "model", "confidence", "uncertainty", "height", "parcel_id", "ring"]


def noise(key: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """A number in [low, high) that follows from the key, so that a rerun draws the same."""
    return low + (high - low) * (F.conv(F.substring(F.md5(key), 1, 6), 16, 10).cast("double") / 16777216.0)


def _cut_off(value: Column, places: int) -> Column:
    return F.floor(value * 10**places) / float(10**places)


def from_images(requests: DataFrame, assets: DataFrame, extracted: DataFrame) -> DataFrame:
    """Rows of `extracted` (asset_id, obs_id, type, confidence, uncertainty, height, ring) that belong to the first ORI asset of each dataset asked for.

    Heights stay only where the request wants them. A dataset without such an asset, or whose image gave nothing, has no row.
    """
    keys = assets.where("type = 'ORI'").join(requests.select("dataset_id").distinct(), "dataset_id", "left_semi")
    image = first_assets(keys, "dataset_id").select("dataset_id", "asset_id")
    rows = extracted.join(image, "asset_id").join(requests.select("dataset_id", "with_height").distinct(), "dataset_id")
    return rows.withColumns({"model": F.lit(FROM_IMAGES), "height": F.when(F.col("with_height"), F.col("height")), "parcel_id": F.lit(None).cast("string")}).select(COLUMNS)


def _building(ring: Column, bounds: Column, key: Column) -> Column:
    """A rectangle inside the bounds of the inset ring, cut by it; an empty ring where there is no room."""
    x0, y0, x1, y1 = (bounds[n] for n in BOUNDS)
    draw = lambda what, span: noise(F.concat(key, F.lit(f"/{what}")), *span)
    size = F.struct(((x1 - x0) * draw("w", SIDE)).alias("w"), ((y1 - y0) * draw("h", SIDE)).alias("h"))
    place = lambda s: F.struct((x0 + (x1 - x0 - s["w"]) * draw("x", PLACE)).alias("x"), (y0 + (y1 - y0 - s["h"]) * draw("y", PLACE)).alias("y"))
    drawn = lambda s: rings.let(place(s), lambda o: rings.ring((o["x"], o["y"]), (o["x"] + s["w"], o["y"]), (o["x"] + s["w"], o["y"] + s["h"]), (o["x"], o["y"] + s["h"])))
    return rings.clip(rings.let(size, drawn), ring)


def stand_ins(requests: DataFrame, log: DataFrame) -> DataFrame:
    """A building inside every parcel whose newest version meets the dataset's extent, and walls on about WALL_SHARE of its edges.

    `requests` holds dataset_id, with_height, xmin .. ymax; `log` parcel_id, version, ring, xmin .. ymax (bounds of the ring).
    Rings must be convex, as insets are. Parcels that are small, or leave no room for a building, have neither building nor walls;
    null and empty rings have none either. Of requests that are repeated each gives its rows.
    """
    newest = versions.latest(log.select("parcel_id", "version", "ring", "xmin", "ymin", "xmax", "ymax"))
    near = uneven_join(prefixed(requests.select("dataset_id", "with_height", "xmin", "ymin", "xmax", "ymax"), "q_"), prefixed(newest, "p_"), "q_", "p_")
    extent = rings.ring(("q_xmin", "q_ymin"), ("q_xmax", "q_ymin"), ("q_xmax", "q_ymax"), ("q_xmin", "q_ymax"))
    rows = rings.where(near, (F.size("p_ring") > 2) & (rings.area(F.col("p_ring")) >= LEAST_PARCEL) & rings.meets(F.col("p_ring"), extent))
    # Rings are exploded from arrays of one, so that the filters on them do not compute them again.
    rows = rows.select(F.col("q_dataset_id").alias("dataset_id"), F.col("q_with_height").alias("with_height"), F.col("p_parcel_id").alias("parcel_id"), F.col("p_ring").alias("outer"), F.explode(F.array(rings.inset(F.col("p_ring"), INSET))).alias("inner"))
    rows = rows.where((F.size("inner") > 2) & (rings.area(F.col("inner")) >= LEAST_INSET)).withColumn("key", F.concat("dataset_id", F.lit("/"), "parcel_id"))
    rows = rows.withColumn("bounds", F.explode(F.array(F.struct(*(c.alias(n) for n, c in zip(BOUNDS, rings.bounds(F.col("inner")), strict=True))))))
    rows = rows.withColumn("built", F.explode(F.array(_building(F.col("inner"), F.col("bounds"), F.col("key"))))).where((F.size("built") > 2) & (rings.area(F.col("built")) >= LEAST_BUILDING))

    item = lambda kind, key, ring: F.struct(F.lit(kind).alias("type"), key.alias("obs_id"), ring.alias("ring"))
    walls = F.transform(rings.edges(F.col("outer")), lambda e, i: item("WALL", F.concat("key", F.lit("/W"), i.cast("string")), F.array(e["p"], e["q"])))
    long = lambda r: F.sqrt((r[1]["x"] - r[0]["x"]) * (r[1]["x"] - r[0]["x"]) + (r[1]["y"] - r[0]["y"]) * (r[1]["y"] - r[0]["y"])) >= LEAST_WALL
    walls = F.filter(walls, lambda w: (noise(F.concat(w["obs_id"], F.lit("/is"))) < WALL_SHARE) & long(w["ring"]))
    made = rows.select("dataset_id", "with_height", "parcel_id", F.inline(F.concat(F.array(item("BUILDING", F.concat("key", F.lit("/B")), F.col("built"))), walls)))

    is_building = F.col("type") == "BUILDING"
    figure = lambda what, spans: _cut_off(F.when(is_building, noise(F.concat("obs_id", F.lit(what)), *spans["BUILDING"])).otherwise(noise(F.concat("obs_id", F.lit(what)), *spans["WALL"])), 3)
    return made.withColumns({
        "model": F.lit(STAND_IN), "confidence": figure("/c", CONFIDENCE), "uncertainty": figure("/u", UNCERTAINTY),
        "height": F.when(is_building & F.col("with_height"), _cut_off(noise(F.concat("obs_id", F.lit("/h")), *HEIGHT), 1)),
    }).select(COLUMNS)


def evidence_stage(requests: DataFrame, assets: DataFrame, extracted: DataFrame, log: DataFrame) -> DataFrame:
    """Each dataset's observations from its images, or stand-ins where these gave none; never both."""
    seen = from_images(requests, assets, extracted)
    blind = requests.join(seen.select("dataset_id").distinct(), "dataset_id", "left_anti")
    return seen.unionByName(stand_ins(blind, log))
