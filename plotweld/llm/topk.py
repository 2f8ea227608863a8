"""Exact top-k inner products: norm-sorted scan with SVD-rotated partial sums.

Components become the integers floor(scale x), so scores are exact. Candidates lie in blocks by range of their length
(Euclidean norm), longest first. A block of queries meets a block of candidates in one task, bounded by QUERY_BLOCK and
CANDIDATE_BLOCK rows; pairs of blocks whose longest vectors cannot reach the queries' floors are never made. The task
walks its candidates in runs of descending length and stops a query where |q| |x| falls below its k-th
score so far (Cauchy-Schwarz); for the runs in between, rotation onto the right singular vectors of all candidates
puts most of the energy in the leading coordinates: their partial product plus the product of the residual lengths
bounds the score, and only rows whose bound reaches the k-th score are scored exactly. Every query starts from its k-th
score over SEED_ROWS of the longest candidates.

Queries are rows of a table, never brought to the driver; there come one d x d second-moment matrix for each vector
length, summed in the cluster, and the seed rows, at most SEED_ROWS for each length.

Scores are whole numbers of any size: where |q| |x| passes 2**62, products are summed in whole numbers of Python.
The result's long is cut to its range where a score passes it; up to 2**124 such scores keep their order.

Null vectors and vectors with null or non-finite components take no part; vectors of another
length than the query's are not scored. Ties go to the smaller vec_id, also at the cut. Rows without vec_id take
no part. A repeated vec_id is never its own candidate; its rows otherwise count each for itself. Other columns are
left out. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, col
from .embedding_dedup import clean_vectors

QUERY_BLOCK = 8192
CANDIDATE_BLOCK = 8192
SCAN_BLOCK = 512
SEED_ROWS = 4096
LEAD = 16
SAFE = 2.0**62
LIMB = 1 << 62
LAST = (1 << 63) - 1
VECTOR = "vec_id bigint, dims int, norm double, raw binary"
SCORE = "query_id bigint, vec_id bigint, hi bigint, lo bigint"


def _prepare(scale: int):
    """Vectors that take part: their length, the norm of the scaled whole numbers, and the components as they are."""

    def run(batches):
        for batch in batches:
            held = []
            for i, v in zip(batch.column(0).to_pylist(), clean_vectors(batch.column(1)), strict=True):
                if v is not None and i is not None and len(v):
                    with np.errstate(over="ignore"):
                        held.append((i, len(v), float(np.linalg.norm(np.floor(scale * v))), v.tobytes()))
            ids, dims, norms, raws = zip(*held, strict=True) if held else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(norms, pa.float64()), pa.array(raws, pa.binary())], ["vec_id", "dims", "norm", "raw"])

    return run


def _moments(scale: int):
    """The second-moment matrix of each vector length, summed over the partition; vectors near the end of the range are left out, which costs pruning only."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, group in pd.DataFrame({"d": batch.column(0).to_pylist(), "norm": batch.column(1).to_pylist(), "raw": batch.column(2).to_pylist()}).groupby("d"):
                x = np.floor(scale * np.frombuffer(b"".join(group["raw"][group["norm"] < 1e100]), np.float64).reshape(-1, d))
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([m.ravel().tolist()], pa.list_(pa.float64()))], ["dims", "m"])

    return run


def rotation(m: np.ndarray) -> np.ndarray:
    """The leading right singular vectors by falling singular value, as columns."""
    return np.linalg.eigh(m)[1][:, ::-1][:, :LEAD]


def whole(raw: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale x) as whole numbers of Python; from 2**52 on a component is whole itself."""
    return np.array([[math.floor(scale * x) if abs(x) < 2.0**52 else int(x) * scale for x in row] for row in raw.tolist()], object).reshape(raw.shape)


class _Best:
    """The k best (score, id) of each query: higher score first, then smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.found: list[list[tuple[int, int]]] = [[] for _ in range(queries)]
        self.kth = np.full(queries, -np.inf)

    def add(self, q: int, score: list[int], ids: list[int]) -> None:
        best = sorted([*self.found[q], *((-s, i) for s, i in zip(score, ids, strict=True))])[: self.k]
        self.found[q] = best
        if len(best) == self.k:
            try:
                self.kth[q] = float(-best[-1][0])
            except OverflowError:
                self.kth[q] = -np.inf if best[-1][0] > 0 else np.finfo(float).max


def scan(queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, basis: np.ndarray, k: int, scale: int) -> _Best:
    """The k best of each query among `rows`, whose scaled lengths fall; `floors` are known k-th scores."""
    best = _Best(len(queries), k)
    with np.errstate(over="ignore", invalid="ignore"):
        q, f = np.floor(scale * queries), np.floor(scale * rows)
        q_len, f_len = np.linalg.norm(q, axis=1), np.linalg.norm(f, axis=1)
        q_head, f_head = q @ basis, f @ basis
        # Lengths of the residuals, from what the head leaves of the whole.
        q_rest, f_rest = (np.sqrt(np.maximum(0.0, n * n - (h * h).sum(1)) + 1e-9 * n * n) for n, h in ((q_len, q_head), (f_len, f_head)))
        small = q_len.max(initial=0) * f_len.max(initial=0) < SAFE and np.isfinite(q_len).all() and np.isfinite(f_len).all()
        exact_q, exact_f = (q.astype(np.int64), f.astype(np.int64)) if small else (None, None)
        alive = np.arange(len(queries))
        for at in range(0, len(rows), SCAN_BLOCK):
            part = slice(at, at + SCAN_BLOCK)
            kth = np.maximum(best.kth[alive], floors[alive])
            longest = f_len[part].max()
            alive = alive[~(q_len[alive] * longest * (1 + 1e-9) + 1 < kth)]
            if not len(alive):
                break
            kth = np.maximum(best.kth[alive], floors[alive])
            bound = q_head[alive] @ f_head[part].T + q_rest[alive][:, None] * f_rest[part][None, :]
            bound += 1e-9 * q_len[alive][:, None] * f_len[part][None, :] + 1
            hits = ~(bound < kth[:, None]) & (query_ids[alive][:, None] != row_ids[part][None, :])
            for n in np.flatnonzero(hits.any(1)):
                a, c = alive[n], at + np.flatnonzero(hits[n])
                if small:
                    score = exact_f[c] @ exact_q[a]
                    if len(c) > k:
                        # Only what reaches the k-th of these; equal scores all stay.
                        top = score >= np.partition(score, -k)[-k]
                        c, score = c[top], score[top]
                    best.add(a, score.tolist(), row_ids[c].tolist())
                else:
                    best.add(a, (whole(rows[c], scale) @ whole(queries[a : a + 1], scale)[0]).tolist(), row_ids[c].tolist())
    return best


def _matrix(raws) -> np.ndarray:
    rows = list(raws)
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def _with_floors(shared, k: int, scale: int):
    """Each query's k-th score over the seed rows of its length."""

    def run(batches):
        seeds = shared.value
        for batch in batches:
            floors = np.full(batch.num_rows, -np.inf)
            dims = np.array(batch.column(1).to_pylist(), np.int64)
            for d in np.unique(dims):
                mine = np.flatnonzero(dims == d)
                if d in seeds:
                    raws, ids, basis = seeds[d]
                    for at in range(0, len(mine), SCAN_BLOCK):
                        some = mine[at : at + SCAN_BLOCK]
                        floors[some] = scan(_matrix(batch.column(3).take(some).to_pylist()), np.array(batch.column(0).take(some).to_pylist()), floors[some], raws, ids, basis, k, scale).kth
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors)], [*batch.schema.names, "floor"])

    return run


def _tile(shared, k: int, scale: int):
    """The k best of a block of queries in a block of candidates."""

    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(candidates) and len(queries):
            order = candidates.sort_values(["norm", "vec_id"], ascending=[False, True])
            ids = queries["vec_id"].to_numpy(np.int64)
            best = scan(_matrix(queries["raw"]), ids, queries["floor"].to_numpy(float), _matrix(order["raw"]), order["vec_id"].to_numpy(np.int64), shared.value[int(order["dims"].iloc[0])], k, scale)
            rows = [(q, i, max(-LIMB, min(LIMB, -s >> 62)), -s & (LIMB - 1)) for q, found in zip(ids.tolist(), best.found, strict=True) for s, i in found]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "hi", "lo"]).astype(np.int64)

    return run


def _blocks(spark: SparkSession, rows: DataFrame, size: int, order: list) -> DataFrame:
    """`rows` with a number `block` of `size` rows next to each other in an order; a block holds rows of one length.

    Blocks go on from one partition to the next, so their number follows from the rows, not from the partitions.
    """
    dealt = Scratch(spark, "blocks").save(rows.repartitionByRange("dims", *order).sortWithinPartitions("dims", *order).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    starts = dealt.groupBy("part", "dims").agg(F.min("at").alias("start"), F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("dims").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = starts.select("part", "dims", (F.coalesce(before, F.lit(0)) - F.col("start")).alias("shift"))
    number = F.floor((F.col("at") + F.col("shift")) / size)
    return dealt.join(F.broadcast(starts), ["part", "dims"]).withColumn("block", F.shiftleft(F.col("dims").cast("bigint"), 40) + number).drop("part", "at", "shift")


def exact_top_k(spark: SparkSession, vectors: DataFrame, queries: DataFrame | None = None, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best; queries default to ids divisible by `every`.

    A query given twice, with equal vectors, is asked once.
    """
    box = Scratch(spark, "topk")
    pick = lambda df: df.select(col(id_col).cast("bigint").alias("vec_id"), col(vector_col).cast("array<double>").alias("v")).mapInArrow(_prepare(scale), VECTOR)
    rows = box.save(_blocks(spark, pick(vectors), CANDIDATE_BLOCK, [F.col("norm").desc(), F.col("vec_id")]))
    bases = {d: rotation(m) for d, m in _summed(rows.select("dims", "norm", "raw").mapInArrow(_moments(scale), "dims int, m array<double>")).items()}
    first = rows.groupBy("dims").agg(F.max("norm").alias("longest"))
    seeds = {}
    for d in [r.dims for r in first.select("dims").collect()]:
        top = rows.where(F.col("dims") == d).orderBy(F.col("norm").desc(), "vec_id").limit(SEED_ROWS).select("vec_id", "raw").collect()
        seeds[d] = (_matrix(r.raw for r in top), np.array([r.vec_id for r in top]), bases[d])
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "dims", "norm", "raw") if queries is None else pick(queries)
    asked = asked.dropDuplicates(["vec_id", "raw"])
    asked = asked.mapInArrow(_with_floors(spark.sparkContext.broadcast(seeds), k, scale), VECTOR + ", floor double")
    asked = box.save(_blocks(spark, asked, QUERY_BLOCK, [F.col("norm").desc(), F.col("vec_id")]))
    # Blocks that can meet: one row for each block of either side.
    c = rows.groupBy("dims", F.col("block").alias("c")).agg(F.max("norm").alias("c_norm"))
    q = asked.groupBy(F.col("dims").alias("d"), F.col("block").alias("q")).agg(F.max("norm").alias("q_norm"), F.min("floor").alias("q_floor"))
    reach = F.col("c_norm") * F.col("q_norm") * (1 + 1e-9) + 1
    tiles = c.join(q, F.col("dims") == F.col("d")).where(F.isnan(reach) | (reach >= F.col("q_floor"))).select("c", "q")
    left = rows.join(tiles.withColumnRenamed("c", "block"), "block").select("vec_id", "dims", "norm", "raw", F.col("block").alias("c"), "q")
    right = asked.join(tiles.withColumnRenamed("q", "block"), "block").select("vec_id", "raw", "floor", "c", F.col("block").alias("q"))
    found = left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInPandas(_tile(spark.sparkContext.broadcast(bases), k, scale), SCORE)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("hi").desc(), F.col("lo").desc(), "vec_id"))
    score = F.when(F.col("hi") > 1, F.lit(LAST)).when(F.col("hi") < -2, F.lit(-LAST - 1)).otherwise(F.shiftleft("hi", 62).bitwiseOR(F.col("lo")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))


def _summed(moments: DataFrame) -> dict[int, np.ndarray]:
    """One d x d matrix for each vector length, summed in the cluster entry by entry."""
    entries = moments.select("dims", F.posexplode("m").alias("at", "x")).groupBy("dims", "at").agg(F.sum("x").alias("x"))
    out: dict[int, np.ndarray] = {}
    for r in entries.collect():
        out.setdefault(r.dims, np.zeros(r.dims * r.dims))[r.at] = r.x
    return {d: m.reshape(d, d) for d, m in out.items()}
