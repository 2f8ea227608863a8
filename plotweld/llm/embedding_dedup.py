"""Near-duplicate embeddings inside a label by int8 quantised tile products.

Vectors become unit vectors u = s q + d with q in int8 and the residual length e = |d| computed
exactly. For a pair |u.v - s t q.r| <= e_u |t r| + e_v, so a tile of int8 products (carried
out exactly in single precision: every partial sum stays below 2**24) proves most pairs to be under the
threshold; only the rest is recomputed in double precision from the original components.

Equal vectors of a label are collapsed first, so a vector that a third of all rows share costs
one comparison. A label is cut into blocks by the angle to a fixed direction; a pair of blocks
whose angle ranges lie further apart than the threshold angle can hold no pair and is never
made. What is left is one bounded task a pair of blocks. Only counts of links and a spanning
forest leave a task.

A vector's row carries its label and components whatever other columns are called; those are left out. Ids are whole
numbers. An empty table gives an empty result. A cosine of just the threshold links.

Null labels, null vectors, zero vectors and vectors with null or non-finite components link with
nothing. Vectors of different length are never similar. A repeated vec_id shares its component.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, col
from .components import components, union_find

BLOCK = 1024
SALTS = 16
#: Largest length for which int8 products sum exactly in single precision.
EXACT_DIMS = 1040


def clean_vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Rows as doubles; None for null rows and rows with null or non-finite components."""
    out: list[np.ndarray | None] = []
    for row in column:
        values = row.values if row.is_valid else None
        if values is None or values.null_count:
            out.append(None)
            continue
        v = values.to_numpy(zero_copy_only=False).astype(np.float64)
        out.append(v if np.isfinite(v).all() else None)
    return out


def direction(dims: int) -> np.ndarray:
    v = np.random.default_rng(dims).standard_normal(dims)
    return v / np.linalg.norm(v)


def _prepare(batches):
    for batch in batches:
        raw, angle = [], []
        for v in clean_vectors(batch.column(2)):
            norm = 0.0 if v is None or not len(v) else float(np.linalg.norm(v / np.abs(v).max())) if np.abs(v).max() > 0 else 0.0
            raw.append(v.tobytes() if norm > 0 else None)
            angle.append(float(math.acos(max(-1.0, min(1.0, (v / np.abs(v).max() / norm) @ direction(len(v)))))) if norm > 0 else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary()), pa.array(angle, pa.float64())], ["vec_id", "label", "raw", "angle"])


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scaled vectors, unit vectors, int8 codes as singles with their scale, and residual lengths."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.abs(u).max(axis=1) / 127.0
    q = np.rint(u / scale[:, None])
    e = np.linalg.norm(u - scale[:, None] * q, axis=1) + 1e-12
    return u, q, scale, e


def similar_pairs(a: np.ndarray, b: np.ndarray, threshold: float):
    """Index pairs (i, j) of rows of `a` and `b` whose cosine is at least `threshold`."""
    ua, qa, sa, ea = _unit(a)
    ub, qb, sb, eb = _unit(b)
    kind = np.float32 if a.shape[1] <= EXACT_DIMS else np.float64
    rough = (qa.astype(kind) @ qb.astype(kind).T).astype(np.float64) * (sa[:, None] * sb[None, :])
    slack = ea[:, None] * np.linalg.norm(sb[:, None] * qb, axis=1)[None, :] + eb[None, :]
    i, j = np.nonzero(rough + slack >= threshold - 1e-9)
    keep_i, keep_j = [], []
    for k in range(0, len(i), 65536):
        x, y = i[k : k + 65536], j[k : k + 65536]
        va, vb = a[x], b[y]
        cos = (va * vb).sum(1) / (np.sqrt((va * va).sum(1)) * np.sqrt((vb * vb).sum(1)))
        far = ~np.isfinite(cos) | (cos == 0)  # squares out of range: take the scaled vectors
        cos[far] = (ua[x][far] * ub[y][far]).sum(1)
        keep_i.append(x[cos >= threshold])
        keep_j.append(y[cos >= threshold])
    none = np.zeros(0, np.int64)
    return (np.concatenate(keep_i), np.concatenate(keep_j)) if keep_i else (none, none)


def _tile(threshold):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rep, weight = pdf["rep"].to_numpy(np.int64), pdf["size"].to_numpy(np.int64)
        x = np.stack([np.frombuffer(r, np.float64) for r in pdf["raw"]])
        same = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        left = np.arange(len(rep)) if same else np.flatnonzero(pdf["block"].to_numpy() == pdf["i"].iloc[0])
        right = left if same else np.flatnonzero(pdf["block"].to_numpy() == pdf["j"].iloc[0])
        links, roots = np.zeros(len(rep), np.int64), {}
        if len(left) and len(right):
            a, b = similar_pairs(x[left], x[right], threshold)
            a, b = left[a], right[b]
            if same:
                a, b = a[a < b], b[a < b]
            np.add.at(links, a, weight[b])
            np.add.at(links, b, weight[a])
            roots = union_find(zip(rep[a].tolist(), rep[b].tolist(), strict=True))
        linked = np.flatnonzero(links)
        return pd.DataFrame({"rep": rep[linked], "root": np.array([roots[r] for r in rep[linked].tolist()], np.int64), "links": links[linked]})

    return run


def embedding_near_dedup(spark: SparkSession, vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept (see the module text)."""
    box = Scratch(spark, "vectors")
    rows = vectors.select(col(id_col).cast("bigint").alias("vec_id"), col(label_col).cast("string").alias("label"), col(vector_col).cast("array<double>").alias("v"))
    prepared = box.save(rows.mapInArrow(_prepare, "vec_id bigint, label string, raw binary, angle double"))
    can = prepared.where("raw is not null and label is not null and vec_id is not null")
    # A class is a distinct vector of a label; its node is its smallest vec_id.
    reps = box.save(can.groupBy("label", "raw").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.min("angle").alias("angle")))
    parts = reps.withColumn("len", F.octet_length("raw"))
    # Blocks by angle: equal-width cells of a label, each split by hash where it is too full.
    width = math.acos(threshold) / 2
    cells = parts.withColumn("cell", F.floor(F.col("angle") / width).cast("int"))
    full = cells.groupBy("label", "len", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cuts"))
    # A cell may hold much of a label: its rows meet their count in salted parts.
    full = full.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    cells = cells.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))
    placed = cells.join(full, ["label", "len", "cell", "salt"]).drop("salt").withColumn("cut", F.pmod(F.xxhash64("rep"), F.col("cuts")).cast("int"))
    placed = placed.withColumn("block", F.col("cell") * 1_000_000 + F.col("cut"))
    blocks = placed.groupBy("label", "len", "block", "cell").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"))
    near, reach = blocks.alias("p"), math.acos(threshold) + 1e-9
    other = blocks.select(F.col("label").alias("l2"), F.col("len").alias("n2"), F.col("block").alias("b2"), F.explode(F.array(*(F.col("cell") + d for d in range(-3, 4)))).alias("c2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = near.join(other, (F.col("p.label") == F.col("l2")) & (F.col("p.len") == F.col("n2")) & (F.col("p.cell") == F.col("c2")))
    pairs = pairs.where((F.col("lo2") - F.col("hi") <= reach) & (F.col("lo") - F.col("hi2") <= reach))
    pairs = pairs.select("label", "len", "block", F.least("block", "b2").alias("i"), F.greatest("block", "b2").alias("j"))
    tiles = placed.join(pairs, ["label", "len", "block"]).select("label", "len", "rep", "size", "raw", "block", "i", "j")
    found = box.save(tiles.groupBy("label", "len", "i", "j").applyInPandas(_tile(threshold), "rep bigint, root bigint, links bigint"))
    linked = components(spark, found.select("rep", "root"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    label = reps.join(linked, reps.rep == linked.node, "left").join(links, "rep", "left")
    label = label.select(F.col("label").alias("l"), F.col("raw").alias("r"), F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    out = prepared.join(label, (prepared.label == label.l) & (prepared.raw == label.r) & prepared.vec_id.isNotNull(), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
