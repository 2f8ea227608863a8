"""Registered queries of layers whose boxes differ much in size or in density."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RULES
from ..functions import geometry as g
from ..operators.spatial_join import prefixed
from ..operators.uneven_join import uneven_join
from ..sources import fixtures
from .queries import PAIRS, Plan, query

UNEVEN = f""",
big AS ({fixtures.sql("district_or_parcel", "//")}), shed AS ({fixtures.sql("shed_in_one_block", "//")})"""
GAP = "greatest(0, b.xmin - s.xmax, s.xmin - b.xmax) ** 2 + greatest(0, b.ymin - s.ymax, s.ymin - b.ymax) ** 2"


@query(f"SELECT b.id, count(*) AS sheds, min(s.id) AS first_shed, max(s.id) AS last_shed, round(sum(s.xmin - 500000), 4) AS sum_x FROM big b JOIN shed s ON {GAP} <= 4 GROUP BY b.id", UNEVEN)
def sheds_near_uneven(p: Plan) -> DataFrame:
    """Districts as wide as the map and single parcels, each with the sheds of one crowded block within 2 m.

    Sheds on the same box are counted first and meet as one: a smallest name is found by sorting, for each pair otherwise.
    """
    sheds = p.layer("shed_in_one_block").groupBy("xmin", "ymin", "xmax", "ymax").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))
    pairs = uneven_join(prefixed(p.layer("district_or_parcel"), "s_"), prefixed(sheds, "t_"), "s_", "t_", 2.0)
    return pairs.groupBy(F.col("s_id").alias("id")).agg(F.sum("t_n").alias("sheds"), F.min("t_first").alias("first_shed"), F.max("t_last").alias("last_shed"), F.round(F.sum((F.col("t_xmin") - 500000) * F.col("t_n")), 4).alias("sum_x"))


@query("SELECT parcel_id AS source_id, t_id AS target_id, round(sqrt(dx * dx + dy * dy), 6) AS gap FROM cand", PAIRS)
def candidate_pairs_uneven(p: Plan) -> DataFrame:
    """The candidates of every source parcel, found without a cell size to choose."""
    radius = g.search_radius(F.col("s_sigma"), RULES.registration_sigma, RULES.radius_k, RULES.radius_min)
    pairs = uneven_join(prefixed(p.layer("source_parcel"), "s_"), prefixed(p.layer("target_parcel"), "t_"), "s_", "t_", radius)
    return pairs.select(F.col("s_parcel_id").alias("source_id"), F.col("t_parcel_id").alias("target_id"), F.round(g.distance(g.box("s_"), g.box("t_")), 6).alias("gap"))


@query("""SELECT a.id AS id_a, b.id AS id_b, greatest(0, least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * greatest(0, least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin)) AS common
FROM big a JOIN big b ON a.id < b.id AND a.xmin < b.xmax AND b.xmin < a.xmax AND a.ymin < b.ymax AND b.ymin < a.ymax""", UNEVEN)
def overlaps_uneven(p: Plan) -> DataFrame:
    """Overlapping pairs of one layer that holds districts and parcels, each pair once, with the common area."""
    rows = p.layer("district_or_parcel")
    a, b = g.box("a_"), g.box("b_")
    pairs = uneven_join(prefixed(rows, "a_"), prefixed(rows, "b_"), "a_", "b_").where("a_id < b_id").withColumn("common", g.intersection_area(a, b))
    return pairs.where("common > 0").select(F.col("a_id").alias("id_a"), F.col("b_id").alias("id_b"), "common")
