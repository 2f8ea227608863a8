"""Exact Jaccard self-join of documents on word shingles by T-occurrence search.

Plan, every step distributed and bounded by the input:

1. Every text becomes a set of 64-bit shingle hashes; equal sets form one class. A class bears the set's fingerprint
   f1, mixed with a second one and the size where two sets share f1 (those few f1 are found first and broadcast).
2. Postings (token, class) are dealt by token range as compressed blocks, so the document
   frequency of every token is exact. Tokens seen in one class only cannot join anything and
   stop here. Very frequent tokens, found on a bounded sample, are spread over salted groups:
   they need no counting, being frequent, and the choice changes the layout and not the result.
3. Postings return to their class. With the rarest tokens first, a class whose prefix of
   n - ceil(t n) + 1 tokens holds only unshared tokens has no partner and is left out.
4. Classes that share a prefix token are grouped (connected components of class and token; a frequent token's
   classes meet in salted parts first). Groups are packed into blocks bounded in tokens and rows; a group
   above the block size is cut into chunks and all pairs of chunks are searched, so no pair is lost and no task grows with a group.
5. Inside a block, DivideSkip: merge the short inverted lists of a query, probe the L longest by
   binary search, keep what reaches the required overlap. Where probing would cost more than
   merging (dense groups of copies), all lists are merged.

Tokens keep all 64 bits of their hash, so overlaps are counted on whole hashes. Ties, repeated rows: rows with equal
sets are one class and linked; rows that share an id but not their set are told apart by their class, so each has
its own component. Null, empty and wordless texts have no shingles and link with nothing; a row without id takes
no part (component_id null). Ids may have any type with an order; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, col
from .components import components, union_find
from .textkernel import U64, mix, shingle_sets

SLICE_BYTES = 12_000_000
MIN_SLICES = 16
FLUSH_TOKENS = 1_500_000
SAMPLE_DOCS = 5_000
HOT_SHARE = 0.01
HOT_SALTS = 32
BLOCK_TOKENS = 250_000
BLOCK_ROWS = 500
PIVOT_SALTS = 16


def _prints(s: np.ndarray) -> tuple[int, int]:
    """Two fingerprints of a set of hashes."""
    f1 = mix(np.add.reduce(mix(s), keepdims=True) + U64(len(s))).view(np.int64)[0]
    return int(f1), int(np.bitwise_xor.reduce(mix(s ^ U64(0x5851F42D4C957F2D))).view(np.int64))


def _fingerprints(width, prints):
    def run(batches):
        for batch in batches:
            n, f1, f2 = [], [], []
            for s in shingle_sets(batch.column(1), width):
                a, b = prints(s) if len(s) else (None, None)
                n.append(len(s))
                f1.append(a)
                f2.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64())], ["doc_id", "n", "f1", "f2"])

    return run


def _sampled_tokens(width):
    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column(0), width))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.zeros(0, U64)]).view(np.int64))], ["token"])

    return run


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed: the upper planes of sorted differences are mostly zero."""
    parts = [np.array([len(arrays), *(x for a in arrays for x in (len(a), a.dtype.itemsize))], np.int64).tobytes()]
    parts += [np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    k = int(raw[:8].view(np.int64)[0])
    head = raw[8 : 8 + 16 * k].view(np.int64).reshape(-1, 2)
    out, at = [], 8 + 16 * k
    for (n, size), kind in zip(head, kinds, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).reshape(-1))
        at += n * size
    return out


def _steps(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=sorted_values.dtype.type(0))


def _postings(width: int, slices: int, hot: np.ndarray, doubled: frozenset, prints):
    """Blocks of (token, class) by token range; hot tokens go to salted groups after the ranges."""

    def flush(sets, classes, turn):
        tok = np.concatenate(sets)
        doc = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
        f1 = np.array(classes, np.int64)
        order = np.argsort(tok, kind="stable")
        tok, doc = tok[order], doc[order]
        at = np.searchsorted(hot, tok)
        is_hot = hot[np.minimum(at, len(hot) - 1)] == tok if len(hot) else np.zeros(len(tok), bool)
        groups, blobs = [], []

        def put(group, tokens, docs):
            used, local = np.unique(docs, return_inverse=True)
            groups.append(group)
            blobs.append(_pack(_steps(tokens), local.astype(np.uint32), f1[used]))

        if is_hot.any():
            put(slices + turn % HOT_SALTS, at[is_hot].astype(U64), doc[is_hot])
            tok, doc = tok[~is_hot], doc[~is_hot]
        at = _slice(tok, slices)
        start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
        for x, y in zip(start, np.r_[start[1:], len(at)], strict=True):
            put(int(at[x]), tok[x:y], doc[x:y])
        return pa.RecordBatch.from_arrays([pa.array(groups, pa.int32()), pa.array(blobs, pa.binary())], ["g", "blob"])

    def run(batches):
        sets, classes, seen, held, turn = [], [], set(), 0, 0
        for batch in batches:
            for s in shingle_sets(batch.column(0), width):
                if not len(s):
                    continue
                f1, f2 = prints(s)
                if f1 in doubled:
                    f1 ^= f2 ^ len(s)
                if f1 in seen:
                    continue
                seen.add(f1)
                sets.append(s)
                classes.append(f1)
                held += len(s)
                if held >= FLUSH_TOKENS:
                    turn = hash(f1)
                    yield flush(sets, classes, turn)
                    sets, classes, seen, held = [], [], set(), 0
        if sets:
            yield flush(sets, classes, hash(classes[0]))

    return run


def _slice(hashes: np.ndarray, slices: int) -> np.ndarray:
    """Equal ranges of 64-bit hashes."""
    return ((hashes >> U64(32)) * U64(slices)) >> U64(32)


def _shared(slices: int, buckets: int):
    """Postings of the tokens that two classes or more hold, dealt back by class."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = int(pdf["g"].iloc[0])
        toks, owners = [], []
        for blob in pdf["blob"]:
            d, local, f1 = _unpack(blob, U64, np.uint32, np.int64)
            toks.append(np.cumsum(d, dtype=U64))
            owners.append(f1[local])
        tok, f1 = np.concatenate(toks), np.concatenate(owners)
        if g >= slices:
            ident = (U64(slices) << U64(32)) | tok
            df = np.full(len(tok), 65535, np.uint16)
        else:
            order = np.argsort(tok, kind="stable")
            tok, f1 = tok[order], f1[order]
            twice = np.zeros(len(tok) + 1, bool)
            twice[1:-1] = tok[1:] == tok[:-1]
            some = twice[1:] | twice[:-1]
            tok, f1 = tok[some], f1[some]
            order = np.lexsort((f1, tok))
            tok, f1 = tok[order], f1[order]
            first = np.ones(len(tok), bool)
            first[1:] = (tok[1:] != tok[:-1]) | (f1[1:] != f1[:-1])
            tok, f1 = tok[first], f1[first]
            _, rank, count = np.unique(tok, return_inverse=True, return_counts=True)
            keep = count[rank] > 1
            df = np.minimum(count[rank][keep], 65534).astype(np.uint16)
            ident = (U64(g) << U64(32)) | rank[keep].astype(U64)
            f1 = f1[keep]
        order = np.argsort(f1.view(U64), kind="stable")
        f1, ident, df = f1[order], ident[order], df[order]
        cut = np.searchsorted(_slice(f1.view(U64), buckets), np.arange(buckets + 1, dtype=U64))
        rows = [(b, _pack(_steps(f1[x:y].view(U64)), ident[x:y], df[x:y])) for b, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if x < y]
        return pd.DataFrame(rows, columns=["b", "blob"])

    return run


def _active(percent: int):
    """Classes whose rarest-first prefix holds a shared token, with those tokens."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame(columns=["f1", "n", "tokens", "prefix"], dtype=object)
        if not len(left) or not len(right):
            return empty
        f1s, ids, dfs = [], [], []
        for blob in left["blob"]:
            d, i, df = _unpack(blob, U64, U64, np.uint16)
            f1s.append(np.cumsum(d, dtype=U64).view(np.int64))
            ids.append(i)
            dfs.append(df)
        f1, ident, df = np.concatenate(f1s), np.concatenate(ids), np.concatenate(dfs)
        own = right.sort_values("f1")
        known, sizes = own["f1"].to_numpy(np.int64), own["n"].to_numpy(np.int64)
        order = np.lexsort((ident, df, f1))
        f1, ident, df = f1[order], ident[order], df[order]
        again = np.zeros(len(f1), bool)
        again[1:] = (f1[1:] == f1[:-1]) & (ident[1:] == ident[:-1])
        f1, ident = f1[~again], ident[~again]
        start = np.flatnonzero(np.r_[True, f1[1:] != f1[:-1]])
        held = np.diff(np.r_[start, len(f1)])
        n = sizes[np.searchsorted(known, f1[start])]
        prefix = n - -(-percent * n // 100) + 1 - (n - held)
        rows = [(c, m, np.sort(ident[s : s + h]).tobytes(), ident[s : s + p].astype(np.int64)) for c, m, s, h, p in zip(f1[start], n, start, held, prefix, strict=True) if p > 0]
        return pd.DataFrame(rows, columns=["f1", "n", "tokens", "prefix"]) if rows else empty

    return run


def divide_skip(sets: list[np.ndarray], n: np.ndarray, percent: int, side: np.ndarray | None = None):
    """All pairs (i, j), i < j in order of size, whose Jaccard similarity reaches percent / 100.

    `sets` hold the tokens that may be shared, sorted; `n` the whole set sizes. With `side`, only
    pairs of different sides. A query's candidates are no smaller than itself, so it needs
    an overlap of ceil(2 percent n / (100 + percent)) at least.
    """
    order = np.argsort(n, kind="stable")
    flat = np.concatenate([sets[i] for i in order])
    lens = np.array([len(sets[i]) for i in order])
    owner = np.repeat(np.arange(len(order)), lens)
    _, local = np.unique(flat, return_inverse=True)
    by = np.argsort(local, kind="stable")
    docs = owner[by].astype(np.int64)
    start = np.searchsorted(local[by], np.arange(local.max(initial=0) + 2))
    keys = local[by] * np.int64(len(order)) + docs
    size, at = n[order], np.r_[0, np.cumsum(lens)]
    sides = None if side is None else side[order]
    found_a, found_b = [], []
    for q in range(len(order)):
        toks = local[at[q] : at[q + 1]]
        a, b = start[toks], start[toks + 1]
        long = b - a
        need = -(-2 * percent * int(size[q]) // (100 + percent))
        if len(toks) < need:
            continue
        shared = long > 1
        toks, a, b, long = toks[shared], a[shared], b[shared], long[shared]
        if len(toks) < need:
            continue
        by_length = np.argsort(long, kind="stable")
        skip = min(need - 1, int(need / (0.01 * np.log2(long.max() + 1) + 1)))
        short = by_length[: len(toks) - skip]
        probe = by_length[len(toks) - skip :]
        merged = np.concatenate([docs[x:y] for x, y in zip(a[short], b[short], strict=True)])
        merged = merged[merged > q]
        cand, count = np.unique(merged, return_counts=True)
        least = -(-percent * (size[q] + size[cand]) // (100 + percent))
        ok = count >= least - skip
        if sides is not None:
            ok &= sides[cand] != sides[q]
        cand, count, least = cand[ok], count[ok], least[ok]
        if not len(cand):
            continue
        if len(cand) * skip * 8 < long[probe].sum():
            want = toks[probe][None, :] * np.int64(len(order)) + cand[:, None]
            hit = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            total = count + (keys[hit] == want).sum(1)
        else:
            every = np.bincount(np.concatenate([docs[x:y] for x, y in zip(a, b, strict=True)]), minlength=len(order))
            total = every[cand]
        good = cand[total >= least]
        if len(good):
            found_a.append(np.full(len(good), order[q]))
            found_b.append(order[good])
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (none, none)


def _search(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.int64) for x in pdf["tokens"]]
        f1, weight = pdf["f1"].to_numpy(np.int64), pdf["size"].to_numpy(np.int64)
        cross = pdf["i"].iloc[0] != pdf["j"].iloc[0]
        a, b = divide_skip(sets, pdf["n"].to_numpy(np.int64), percent, pdf["side"].to_numpy() if cross else None)
        links = np.zeros(len(f1), np.int64)
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        roots = union_find(zip(f1[a].tolist(), f1[b].tolist(), strict=True))
        linked = np.flatnonzero(links)
        return pd.DataFrame({"f1": f1[linked], "root": np.array([roots[x] for x in f1[linked].tolist()], np.int64), "links": links[linked]})

    return run


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, fingerprint=_prints) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, n_links.

    component_id is the smallest doc_id reachable by links; n_links counts the other rows linked directly, copies
    included. An empty table gives an empty result.
    """
    box = Scratch(spark, "ngram")
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    prints = box.save(rows.mapInArrow(_fingerprints(width, fingerprint), f"doc_id {kind}, n bigint, f1 bigint, f2 bigint"))
    known = prints.where("f1 is not null and doc_id is not null")
    # Chance alone makes few of them: n classes share about n * n / 2**65 fingerprints.
    doubled = frozenset(r[0] for r in known.groupBy("f1").agg((F.min("f2") != F.max("f2")).alias("a"), (F.min("n") != F.max("n")).alias("b")).where("a or b").select("f1").collect())
    own = F.when(F.col("f1").isin(*doubled), F.col("f1").bitwiseXOR(F.col("f2")).bitwiseXOR(F.col("n"))).otherwise(F.col("f1")) if doubled else F.col("f1")
    prints, known = prints.withColumn("f1", own), known.withColumn("f1", own)
    classes = box.save(known.groupBy("f1").agg(F.min("n").alias("n"), F.count("*").alias("size"), F.min("doc_id").alias("least")))
    text = rows.where("doc_id is not null and text is not null")
    total, count = text.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    slices = max(MIN_SLICES, -(-int(total or 0) // SLICE_BYTES))

    every = max(1, count // SAMPLE_DOCS)
    sample = text.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text")
    hot_least = max(16, int(HOT_SHARE * count / every))
    hot = np.sort(np.array([r[0] for r in sample.mapInArrow(_sampled_tokens(width), "token bigint").groupBy("token").count().where(F.col("count") > hot_least).collect()], np.int64).view(U64))

    blocks = text.select("text").mapInArrow(_postings(width, slices, hot, doubled, fingerprint), "g int, blob binary")
    shared = blocks.groupBy("g").applyInPandas(_shared(slices, slices), "b int, blob binary")
    sized = classes.select(((F.shiftrightunsigned(F.col("f1"), 32) * slices) / F.lit(1 << 32)).cast("int").alias("b"), "f1", "n")
    active = box.save(shared.groupBy("b").cogroup(sized.groupBy("b")).applyInPandas(_active(percent), "f1 bigint, n bigint, tokens binary, prefix array<bigint>"))

    # A token's classes meet at its least one, first within salted parts of them, then the parts' least ones.
    tokens = active.select("f1", F.explode("prefix").alias("token")).withColumn("salt", F.pmod(F.xxhash64("f1"), F.lit(PIVOT_SALTS)))
    parts = tokens.groupBy("token", "salt").agg(F.min("f1").alias("part"))
    pivots = parts.groupBy("token").agg(F.min("part").alias("pivot"), F.count("*").alias("c")).where("c > 1")
    near = tokens.join(parts, ["token", "salt"]).where("f1 <> part").select("f1", F.col("part").alias("pivot"))
    far = parts.join(pivots, "token").where("part <> pivot").select(F.col("part").alias("f1"), "pivot")
    edges = box.save(near.unionByName(far).distinct())
    groups = components(spark, edges)
    group = active.join(groups, active.f1 == groups.node).join(classes.select(F.col("f1").alias("c"), "size"), F.col("f1") == F.col("c"))
    group = box.save(group.select("f1", "n", "size", "tokens", F.col("component").alias("k")))
    weigh = F.greatest(F.octet_length("tokens") / 8, F.lit(BLOCK_TOKENS / BLOCK_ROWS))
    weights = group.groupBy("k").agg(F.sum(weigh).alias("w"))
    small_total = weights.where(F.col("w") <= BLOCK_TOKENS).agg(F.sum("w")).first()[0] or 0
    packs = max(MIN_SLICES, int(small_total // BLOCK_TOKENS) + 1)
    placed = group.join(weights, "k").withColumn("cuts", F.when(F.col("w") > BLOCK_TOKENS, F.ceil(2 * F.col("w") / BLOCK_TOKENS)).otherwise(1).cast("int"))
    placed = placed.withColumn("side", F.pmod(F.xxhash64("f1"), F.col("cuts")).cast("int")).withColumn("g", F.when(F.col("cuts") > 1, F.col("k")).otherwise(F.pmod(F.xxhash64("k"), F.lit(packs))))
    other = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("o")
    tiles = placed.select("f1", "n", "size", "tokens", "side", "g", (F.col("cuts") > 1).alias("cut"), other)
    tiles = tiles.select("f1", "n", "size", "tokens", "side", "g", "cut", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"))
    found = box.save(tiles.groupBy("cut", "g", "i", "j").applyInPandas(_search(percent), "f1 bigint, root bigint, links bigint"))

    linked = components(spark, found.select("f1", "root"))
    label = classes.join(linked, classes.f1 == linked.node, "left").select("f1", "size", "least", F.coalesce("component", "f1").alias("k"))
    low = label.groupBy("k").agg(F.min("least").alias("component_id"))
    links = found.groupBy("f1").agg(F.sum("links").alias("links"))
    result = box.save(label.join(low, "k").join(links, "f1", "left").select(F.col("f1").alias("c"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")))
    box.drop(active, edges, group, found)
    out = prints.join(result, (prints.f1 == result.c) & prints.doc_id.isNotNull(), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
