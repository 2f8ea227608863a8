"""Mixing sources to target weights by capped water-filling.

Targets share a budget by weight; a source that would pass `cap` times its own size is clamped
and its excess is reshared by weight among the rest, until none is above. The only thing brought
to the driver is the catalogue of sources: one row for each, with its size.

A document of n words in a source of e epochs (target over size) is taken floor(e) times whole;
the fractional repetition takes the rest of e n words, rounded up or down by a seeded uniform
draw, so a source's taken words differ from its target by a random walk of steps under one word.

Null text has no words. Null is a source of its own, last in order. Null doc_ids draw as "null".
Repeated rows count each. Sources without words have target 0. An empty table gives an empty mix. Other columns
stay as they are, whatever their names; the mix's struct has underscores added where its name is taken.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, free
from .textkernel import text_chunks, word_bounds

WORD = r"[^\x20\x09-\x0D]+"


def water_fill(sizes: list[int], weights: list[float], budget: float, cap: float) -> list[float]:
    """Targets by weight, none above cap times its size; the excess goes to the others by weight."""
    budget = min(budget, cap * sum(sizes))
    clamped: set[int] = set()
    while True:
        free = [i for i in range(len(sizes)) if i not in clamped]
        weight = sum(weights[i] for i in free)
        level = (budget - cap * sum(sizes[i] for i in clamped)) / weight if weight else 0.0
        over = {i for i in free if weights[i] * level > cap * sizes[i]}
        if not over:
            return [cap * sizes[i] if i in clamped else weights[i] * level for i in range(len(sizes))]
        clamped |= over


def uniform(key: Column, seed: int) -> Column:
    """A portable draw in [0, 1) from a row key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> list[tuple[str | None, int, float]]:
    """(source, size, target) of every source; `sized` has columns source and size."""
    found = [(r[0], int(r[1])) for r in sized.groupBy("source").agg(F.sum("size")).collect()]
    found.sort(key=lambda x: (x[0] is None, x[0] or ""))
    w = [weights[i % len(weights)] for i in range(len(found))]
    targets = water_fill([n for _, n in found], w, share * sum(n for _, n in found), cap)
    return [(s, n, float(t)) for (s, n), t in zip(found, targets, strict=True)]


def mix_column(docs: DataFrame) -> str:
    """The name of the mix's struct beside the columns of `docs`."""
    return free("__mix", docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of `docs` with a struct `__mix` of size, source_size, target and taken (see `mix_column`)."""
    # Own names for the input's columns: none clashes with those added here.
    own = dict(zip(docs.columns, (f"c{k}" for k in range(len(docs.columns))), strict=True))
    sized = docs.toDF(*own.values()).withColumn("size", F.coalesce(F.regexp_count(F.col(own[text_col]).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint"))
    targets = source_targets(sized.select(F.col(own[source_col]).alias("source"), "size"), weights, share, cap)
    plan = spark.createDataFrame(targets, "source string, source_size bigint, target double")
    out = sized.join(plan, F.col(own[source_col]).eqNullSafe(F.col("source")))
    raw = F.when(F.col("source_size") > 0, F.floor(F.col("target") * F.col("size") / F.col("source_size") + uniform(F.col(own[id_col]), seed))).otherwise(0)
    taken = F.least(raw.cast("bigint"), F.floor(cap * F.col("size")).cast("bigint"))
    return out.select(*(F.col(own[c]).alias(c) for c in docs.columns), F.struct("size", "source_size", "target", taken.alias("taken")).alias(mix_column(docs)))


def _windows(batches):
    """Cut each text (last column) to `take` words from word `skip` on, with the space between them as it was."""
    for batch in batches:
        skip, take = batch.columns[-3].to_pylist(), batch.columns[-2].to_pylist()
        texts: list[str] = []
        for row, raw, offs in text_chunks(batch.columns[-1]):
            s, e, first = word_bounds(raw, offs)
            for k in range(len(offs) - 1):
                if take[row + k] is None:
                    texts.append(raw[offs[k] : offs[k + 1]].tobytes().decode())
                else:
                    a = first[k] + skip[row + k]
                    texts.append(raw[s[a] : e[a + take[row + k] - 1]].tobytes().decode())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], batch.schema.names)


def materialise_mix(mixed: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", mix_col: str | None = None, whole: bool = False) -> DataFrame:
    """The mix as rows: whole repetitions, then the fractional one as a seeded window of words.

    So every document of a source is cut in its fractional repetition. `whole` takes whole documents instead: the
    fractional repetition of n words keeps all of them with probability rest / n, drawn by the id and seed. The struct
    of `mix_sources` is the last column unless named. Where there is a column n_chars it is brought up to date.
    """
    mix_col = mix_col or mixed.columns[-1]
    columns = [c for c in mixed.columns if c != mix_col]
    own = dict(zip(columns, (f"c{k}" for k in range(len(columns))), strict=True))
    rows = mixed.select(*(col(c).alias(own[c]) for c in columns), *(col(mix_col)[f].alias(f) for f in ("size", "taken"))).where("taken > 0")
    rest, key = F.col("taken") % F.col("size"), F.col(own[id_col])
    if whole:
        rows = rows.withColumn("taken", F.col("taken") - rest + F.when(uniform(key, seed + 1) * F.col("size") < rest, F.col("size")).otherwise(0)).where("taken > 0")
    kept = [c for c in columns if c != text_col]
    parts = rows.select(*(own[c] for c in kept), F.col(own[text_col]).alias("text"), "size", rest.cast("int").alias("rest"), F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))).alias("k"), F.floor(F.col("taken") / F.col("size")).alias("times"))
    cut = F.col("k") > F.col("times")
    skip = F.when(cut, F.floor(uniform(key, seed + 1) * (F.col("size") - F.col("rest") + 1))).cast("int")
    parts = parts.select(*(own[c] for c in kept), skip.alias("skip"), F.when(cut, F.col("rest")).alias("take"), "text")
    out = parts.mapInArrow(_windows, parts.schema)
    value = lambda c: F.col("text") if c == text_col else F.length("text").cast(mixed.schema[c].dataType) if c == "n_chars" else F.col(own[c])
    return out.select(*(value(c).alias(c) for c in columns))
