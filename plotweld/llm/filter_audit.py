"""Interaction of five text filters: what each removes in every order, and its share over all orders.

Every document has a mask of the filters it fails. Per part and label 32 signed parity sums are aggregated, one for
each set of filters: +1 for a document that fails an even number of the set, -1 otherwise. The sums are a Walsh-Hadamard
transform of the counts by mask, and a second transform divided by 32 gives these counts exactly. The orders are then evaluated on
32 cells a part, and the removals of a filter over all orders come in closed form: a document that fails k
filters is removed by each of them in 120 / k of the 120 orders.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
LABELS = ("all", "good", "toxic")


def text_failures(text: Column) -> Column:
    """Mask of the filters A to D that a text fails: few words, repeated words, capitals, odd signs."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))

    def mask(w: Column) -> Column:
        fails = (F.size(w) < 50, 100 * F.size(F.array_distinct(w)) < 65 * F.size(w), 100 * capitals.cast("bigint") > 5 * F.length(text).cast("bigint"), text.rlike(r"[#$%&*|]"))
        return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))

    # One evaluation of the words serves both counts.
    return F.element_at(F.transform(F.array(words), mask), 1)


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask and the counts all, good, toxic: one row for each text, part and set of labels, in halves where E tells its rows apart."""
    text = F.coalesce(col("text"), F.lit(""))
    marked = labels.groupBy(col("doc_id").alias("id")).agg(F.max((col("quality") == 1).cast("int")).alias("good"), F.max((col("toxic") == 1).cast("int")).alias("toxic"))
    rows = docs.select(
        col("doc_id").alias("id"), F.coalesce(col("source"), F.lit("")).alias("part"), text_failures(text).alias("mask"),
        F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), F.length(text).alias("t3"),
    )
    rows = rows.join(marked, "id", "left").fillna(0, ["good", "toxic"])
    kind = ["t1", "t2", "t3", "part", "mask", "good", "toxic"]
    # Counts by id first, so that a text in thousands of copies is never in one task: what meets by text is a row a part and label.
    by_id = rows.groupBy(*kind, "id").agg(F.count("*").alias("n"))
    met = by_id.groupBy(*kind).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n"))).alias("nameless"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least"))
    first = F.min("least.id").over(W.partitionBy("t1", "t2", "t3"))
    spared = F.when(F.col("least.id") == first, F.col("least.n")).otherwise(0) + F.coalesce("nameless", F.lit(0))
    split = met.withColumn("spared", F.coalesce(spared, F.col("n"))).select(
        "part", "good", "toxic", F.explode(F.array(F.struct("mask", F.col("spared").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("spared")).alias("n")))).alias("half"))
    n = F.col("half.n")
    return split.select("part", F.col("half.mask").alias("mask"), n.alias("all"), (n * F.col("good")).alias("good"), (n * F.col("toxic")).alias("toxic")).where(F.col("all") > 0)


def parity(mask: Column, set_: int) -> Column:
    return 1 - 2 * (F.bit_count(mask.bitwiseAND(F.lit(set_))) % 2)


def spectrum(rows: DataFrame) -> DataFrame:
    """For each part and label the signed parity sums, an array by set of filters."""
    by_label = rows.select("part", "mask", F.explode(F.array(*(F.struct(F.lit(x).alias("label"), F.col(x).alias("n")) for x in LABELS))).alias("l")).select("part", "mask", "l.*")
    sums = by_label.groupBy("part", "label").agg(*(F.sum(F.col("n") * parity(F.col("mask"), t)).alias(f"s{t}") for t in range(CELLS)))
    return sums.select("part", "label", F.array(*(f"s{t}" for t in range(CELLS))).alias("sums"))


def cells(sums: DataFrame) -> DataFrame:
    """For each part the counts by mask, an array for each label: the transform undone."""
    count = lambda m: F.aggregate(F.transform("sums", lambda s, t: s * (1 - 2 * (F.bit_count(t.bitwiseAND(m)) % 2))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    own = sums.select("part", "label", F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda m: F.floor(count(m) / CELLS).cast("bigint")).alias("counts"))
    return own.groupBy("part").agg(*(F.max(F.when(F.col("label") == x, F.col("counts"))).alias(x) for x in LABELS))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step.

    Texts are whole; null is empty, as is a null source; empty texts are copies of each other. A row fails E if a smaller
    id has its text, so rows that repeat the smallest id pass; a null id passes and counts as smaller than none. Of
    repeated labels the highest counts; ids without labels are neither good nor toxic. An empty table gives no rows.
    Other columns are not used, whatever they are called.
    """
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    rows = cells(spectrum(masks(docs, labels))).select("part", *LABELS, F.explode(orders).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bits = lambda letters: sum((F.when(F.contains(letters, F.lit(x)), 1 << k).otherwise(0) for k, x in enumerate(FILTERS)), F.lit(0))
    rows = rows.withColumns({"own": bits(F.substring("filter_order", F.col("step"), F.lit(1))), "prior": bits(F.substring("filter_order", F.lit(1), F.col("step") - 1))})
    has, before = (lambda m: m.bitwiseAND(F.col("own")) != 0), (lambda m: m.bitwiseAND(F.col("prior")) != 0)

    def total(counts: str, weight) -> Column:
        return F.aggregate(F.transform(counts, lambda n, m: n * weight(m)), F.lit(0).cast("bigint"), lambda a, x: a + x)

    when = lambda c: F.when(c, 1).otherwise(0).cast("bigint")
    here = lambda m: when(has(m) & ~before(m))
    share = lambda m: F.when(has(m), F.lit(120) / F.bit_count(m)).otherwise(0).cast("bigint")
    return rows.select(
        "part", "filter_order", "step", total("all", lambda m: when(~has(m) & ~before(m))).alias("kept"), total("all", here).alias("removed"), total("all", lambda m: when(has(m) & before(m))).alias("redundant"),
        total("all", lambda m: when(m == F.col("own"))).alias("unique_fails"), total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"), total("all", share).alias("shapley"),
    )
