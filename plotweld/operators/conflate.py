"""Candidates, pair features, six-dimension evidence, ranking, relation decision and fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import RULES, WEIGHTS
from ..functions import geometry as g
from ..functions import rings
from .spatial_join import distance_join, prefixed

BUILDINGS = ("BUILDING", "BUILDING_EDGE", "WALL")


def candidates(sources: DataFrame, targets: DataFrame) -> DataFrame:
    radius = g.search_radius(F.col("s_sigma"), RULES.registration_sigma, RULES.radius_k, RULES.radius_min)
    return distance_join(prefixed(sources, "s_"), prefixed(targets, "t_"), "s_", "t_", radius)


def with_features(pairs: DataFrame) -> DataFrame:
    s, t = g.box("s_"), g.box("t_")
    return pairs.withColumns({
        "iou": g.iou(s, t), "centroid_distance": g.centroid_distance(s, t), "hausdorff": g.boundary_hausdorff(s, t),
        "area_ratio": g.ratio_of_sizes(g.area(s), g.area(t)), "perimeter_ratio": g.ratio_of_sizes(g.perimeter(s), g.perimeter(t)),
        "shape_similarity": g.shape_similarity(s, t), "attribute_similarity": g.attribute_similarity("s_", "t_"), "identity": g.identity(F.col("s_survey_no"), F.col("t_survey_no")),
    })


def rule_probability(pairs: DataFrame) -> DataFrame:
    """A transparent stand-in for a fitted matcher, with its inputs and range."""
    p = 0.7 * F.col("iou") + 0.2 * F.col("attribute_similarity") + 0.1 * F.col("identity")
    return pairs.withColumn("p", F.round(p, 4))


def _spots(points: DataFrame) -> DataFrame:
    return points.select(F.col("point_id").alias("g_id"), *(F.col(c).alias(f"g_{n}") for c, n in (("x", "xmin"), ("y", "ymin"), ("x", "xmax"), ("y", "ymax"))))


def gnss_support(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Survey points near the common area of a pair, or near the source where there is none; pairs with none have no row."""
    s, t = g.box("s_"), g.box("t_")
    i = g.intersection(s, t)
    some = (i[2] > i[0]) & (i[3] > i[1])
    zone = pairs.select("s_parcel_id", "t_parcel_id", *(F.when(some, a).otherwise(b).alias(f"z_{n}") for a, b, n in zip(i, s, ("xmin", "ymin", "xmax", "ymax"), strict=True)), F.when(some, RULES.gnss_radius + 0.01).otherwise(RULES.gnss_radius).alias("z_radius"))
    return distance_join(zone, _spots(points), "z_", "g_", F.col("z_radius")).groupBy("s_parcel_id", "t_parcel_id").agg(F.count("*").alias("n_gnss"))


def building_support(targets: DataFrame, observations: DataFrame) -> DataFrame:
    built = prefixed(observations.where(F.col("type").isin(*BUILDINGS)), "o_")
    near = distance_join(prefixed(targets, "t_"), built, "t_", "o_", 0.0)
    return near.groupBy("t_parcel_id").agg(F.count("*").alias("n_buildings"))


def gnss_support_ring(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The same on convex rings: points near the clipped ring of a pair; cells of the zone's box find them, the ring decides."""
    rows = rings.held(pairs.select("s_parcel_id", "t_parcel_id", F.col("s_ring").alias("source"), "t_ring"), part=rings.clip(F.col("source"), F.col("t_ring")))
    some = F.size("part") > 2
    rows = rows.select("s_parcel_id", "t_parcel_id", F.when(some, F.col("part")).otherwise(F.col("source")).alias("z_ring"), F.when(some, RULES.gnss_radius + 0.01).otherwise(RULES.gnss_radius).alias("z_radius"))
    zone = rings.held(rows, **{f"z_{n}": c for n, c in zip(("xmin", "ymin", "xmax", "ymax"), rings.bounds(F.col("z_ring")), strict=True)})
    near = distance_join(zone, _spots(points), "z_", "g_", F.col("z_radius"))
    spot = F.struct(F.col("g_xmin").alias("x"), F.col("g_ymin").alias("y"))
    return rings.where(near, rings.distance_to(spot, F.col("z_ring")) <= F.col("z_radius")).groupBy("s_parcel_id", "t_parcel_id").agg(F.count("*").alias("n_gnss"))


def building_support_ring(targets: DataFrame, observations: DataFrame) -> DataFrame:
    """The same on rings of any shape: those that share a point."""
    built = prefixed(observations.where(F.col("type").isin(*BUILDINGS)), "o_")
    near = rings.where(distance_join(prefixed(targets, "t_"), built, "t_", "o_", 0.0), rings.meets(F.col("t_ring"), F.col("o_ring")))
    return near.groupBy("t_parcel_id").agg(F.count("*").alias("n_buildings"))


def with_own_evidence(pairs: DataFrame) -> DataFrame:
    """The dimensions that a pair has by itself."""
    return pairs.withColumns({
        "e_geometry": F.round(0.5 * F.col("iou") + 0.25 * F.col("area_ratio") + 0.25 * F.col("shape_similarity"), 4),
        "e_attribute": F.round("attribute_similarity", 4), "e_temporal": F.lit(RULES.temporal), "e_identity": F.col("identity"),
    })


def with_evidence(pairs: DataFrame, points: DataFrame, buildings: DataFrame) -> DataFrame:
    """All six dimensions: those of the pair, and the support of survey points and buildings."""
    rows = pairs.join(gnss_support(pairs, points), ["s_parcel_id", "t_parcel_id"], "left").join(buildings, "t_parcel_id", "left").fillna(0, ["n_gnss", "n_buildings"])
    return with_own_evidence(rows).withColumns({"e_survey": F.round(F.least(F.lit(1.0), F.col("n_gnss") / 3), 4), "e_physical": F.round(F.least(F.lit(1.0), F.col("n_buildings") / 2), 4)})


def ranked(pairs: DataFrame) -> DataFrame:
    order = W.partitionBy("s_parcel_id").orderBy(F.col("p").desc(), "t_parcel_id")
    return pairs.withColumn("rank", F.row_number().over(order))


class Boxes:
    """What the rules measure of a pair, on boxes. A split's coverage sums the children's common area with the parent: children that overlap more than the tolerance fail anyway."""

    child = ("xmin", "ymin", "xmax", "ymax")

    def area(self, side: str) -> Column:
        return g.area(g.box(f"{side}_"))

    def common(self) -> Column:
        return g.intersection_area(g.box("s_"), g.box("t_"))

    def overlap(self, a: Column, b: Column) -> Column:
        return g.intersection_area(*([x[c] for c in self.child] for x in (a, b)))

    def covered(self, side: str, parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0.0), lambda acc, c: acc + c["common"])

    def together(self, parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0.0), lambda acc, c: acc + c["size"])


class Rings(Boxes):
    """The same on rings of any shape: what children share counts once."""

    child = ("ring",)

    def area(self, side: str) -> Column:
        return F.col(f"{side}_area")

    def common(self) -> Column:
        return F.col("common")

    def overlap(self, a: Column, b: Column) -> Column:
        return rings.overlap_area(a["ring"], b["ring"])

    def covered(self, side: str, parts: Column) -> Column:
        return rings.covered_area(F.col(f"{side}_ring"), F.transform(parts, lambda c: c["ring"]))

    def together(self, parts: Column) -> Column:
        return rings.union_area(F.transform(parts, lambda c: c["ring"]))


BOXES, RINGS = Boxes(), Rings()


def boundary_adjusted(measure: Boxes = BOXES) -> Column:
    s, t = measure.area("s"), measure.area("t")
    return (F.col("iou") >= 0.70) & (F.col("centroid_distance") <= 5.0) & (F.abs(s - t) / F.greatest(s, t) < 0.25)


def worst_overlap(parts: Column, measure: Boxes) -> Column:
    """Largest share of the smaller of two parts that they have in common; 0 for a single one."""
    of = lambda a, i: F.transform(F.slice(parts, i + 2, F.size(parts)), lambda b: g.safe_ratio(measure.overlap(a, b), F.least(a["size"], b["size"])))
    return F.coalesce(F.array_max(F.flatten(F.transform(parts, of))), F.lit(0.0))


def decide(sources: DataFrame, scored: DataFrame, measure: Boxes = BOXES) -> DataFrame:
    """One relation for each source, in the fixed order of the rules; also sources without candidates.

    The best row keeps its columns, so those that a query does not ask for are pruned; of the likely others only what the
    rules measure is gathered, in the same window.
    """
    by = W.partitionBy("s_parcel_id")
    order = by.orderBy(F.col("p").desc(), "t_parcel_id")
    part = F.struct("rank", "t_parcel_id", "p", measure.common().alias("common"), measure.area("t").alias("size"), *(F.col(f"t_{n}").alias(n) for n in measure.child))
    likely = F.collect_list(F.when((F.col("rank") <= 4) & (F.col("p") >= RULES.high_p), part))
    rows = scored.withColumns({"rank": F.row_number().over(order), "second": F.coalesce(F.lead("p").over(order), F.lit(0.0))})
    best = rows.withColumn("high", likely.over(by.orderBy("rank").rowsBetween(W.currentRow, W.unboundedFollowing))).where("rank = 1")
    share = lambda c: g.safe_ratio(c["common"], c["size"])
    parent, sizes = measure.area("s"), F.aggregate("high", F.lit(0.0), lambda a, c: a + c["size"])
    split = (
        F.forall("high", lambda c: share(c) >= RULES.child_share) & (g.safe_ratio(measure.covered("s", F.col("high")), parent) >= RULES.split_coverage)
        & (worst_overlap(F.col("high"), measure) <= RULES.split_overlap) & (F.abs(1 - g.safe_ratio(sizes, parent)) <= RULES.area_tolerance)
    )
    clear = (F.col("p") >= RULES.clear_p) & (F.col("p") - F.col("second") >= RULES.clear_margin)
    best = best.withColumn("contested", ~clear & (F.size("high") >= 2))
    # Measured for contested sources alone.
    split = F.when(F.col("contested"), split).otherwise(F.lit(False))
    best = rings.held(best, split=split) if measure is RINGS else best.withColumn("split", split)
    adjusted = boundary_adjusted(measure)
    relation = (
        F.when(F.col("p").isNull(), "NO_MATCH").when(F.col("contested") & F.col("split"), "SPLIT").when(F.col("contested") & (F.col("p") >= 0.75) & (F.col("iou") >= 0.55), F.when(adjusted, "BOUNDARY_ADJUSTMENT").otherwise("ONE_TO_ONE"))
        .when(F.col("contested"), "AMBIGUOUS").when(adjusted & (F.col("p") >= RULES.clear_p), "BOUNDARY_ADJUSTMENT").when(F.col("p") < RULES.no_match_p, "NO_MATCH").otherwise("ONE_TO_ONE")
    )
    ids = F.transform("high", lambda c: c["t_parcel_id"])
    out = sources.select(F.col("parcel_id").alias("source_id")).join(best, F.col("source_id") == F.col("s_parcel_id"), "left").withColumn("relation", relation)
    targets = F.when(F.col("relation") == "SPLIT", ids).when(F.col("relation") == "AMBIGUOUS", F.slice(ids, 1, 3)).when(F.col("relation") == "NO_MATCH", F.array().cast("array<string>")).otherwise(F.array("t_parcel_id"))
    mean = F.aggregate("high", F.lit(0.0), lambda a, c: a + c["p"]) / F.size("high")
    return out.withColumn("targets", targets).withColumn("probability", F.when(F.col("relation") == "SPLIT", F.round(mean, 4)).otherwise(F.coalesce("p", F.lit(0.0)))).drop("contested", "split")


def merges(decided: DataFrame, sources: DataFrame, targets: DataFrame, measure: Boxes = BOXES) -> DataFrame:
    """Targets that two sources or more fill together, with the coverage.

    On boxes every source must lie in the target by half; on rings the union of the sources is measured, and what two of
    them share is held against the smaller one.
    """
    single = decided.where(F.col("relation").isin("ONE_TO_ONE", "BOUNDARY_ADJUSTMENT")).select("source_id", F.col("targets")[0].alias("target_id"))
    rows = single.join(prefixed(sources, "s_"), F.col("source_id") == F.col("s_parcel_id")).join(prefixed(targets, "t_"), F.col("target_id") == F.col("t_parcel_id"))
    if measure is RINGS:
        rows = rows.withColumns({"s_area": rings.area(F.col("s_ring")), "common": rings.overlap_area(F.col("s_ring"), F.col("t_ring"))})
    part = F.struct("source_id", measure.common().alias("common"), measure.area("s").alias("size"), *(F.col(f"s_{n}").alias(n) for n in measure.child))
    kept = [f"t_{n}" for n in measure.child]
    grouped = rows.groupBy("target_id").agg(F.array_sort(F.collect_list(part)).alias("parts"), *(F.first(c).alias(c) for c in kept)).where(F.size("parts") >= 2)
    if measure is RINGS:
        grouped = rings.held(grouped, t_area=rings.area(F.col("t_ring")))
        fits = F.lit(True)
    else:
        fits = F.forall("parts", lambda c: g.safe_ratio(c["common"], c["size"]) >= RULES.child_share)
    parent = measure.area("t")
    coverage = g.safe_ratio(measure.covered("t", F.col("parts")), parent)
    grouped = rings.held(grouped, coverage=coverage) if measure is RINGS else grouped.withColumn("coverage", coverage)
    good = fits & (F.col("coverage") >= RULES.split_coverage) & (worst_overlap(F.col("parts"), measure) <= RULES.split_overlap) & (F.abs(1 - g.safe_ratio(measure.together(F.col("parts")), parent)) <= RULES.area_tolerance)
    return grouped.where(good).select("target_id", F.transform("parts", lambda c: c["source_id"]).alias("sources"), F.lit("MERGE").alias("relation"), F.lit(RULES.merge_p).alias("probability"), "coverage")


def with_merges(decided: DataFrame, merged: DataFrame) -> DataFrame:
    """The decisions, and a row more for each merge: its first source, all sources in `merged_sources`. The sources keep their own rows."""
    extra = merged.select(F.get("sources", F.lit(0)).alias("source_id"), "relation", F.array("target_id").alias("targets"), "probability", F.col("sources").alias("merged_sources"), F.col("coverage").alias("e_geometry"))
    return decided.withColumn("merged_sources", F.lit(None).cast("array<string>")).unionByName(extra, allowMissingColumns=True)


def fuse(rows: DataFrame) -> DataFrame:
    """Weighted score of the six dimensions and whether the strong ones disagree with the weak."""
    e = {d: F.coalesce(F.col(f"e_{d}"), F.lit(0.0)) for d in WEIGHTS}
    e["identity"] = F.when(e["identity"] == 0, F.when(e["attribute"] > 0.5, F.least(F.lit(1.0), e["attribute"] * 1.2)).otherwise(e["attribute"] * 0.8)).otherwise(e["identity"])
    score = sum((e[d] * w for d, w in WEIGHTS.items()), F.lit(0.0)) / sum(WEIGHTS.values())
    strong, weak = (e["survey"] + e["geometry"] + e["physical"]) / 3, (e["attribute"] + e["temporal"] + e["identity"]) / 3
    return rows.withColumn("fusion_score", F.round(score, 4)).withColumn("disagreement", F.abs(strong - weak) > 0.3)
