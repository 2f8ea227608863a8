"""Repeated passages: every byte covered by a string of `width` bytes that also starts somewhere else.

Each string of `width` bytes has one anchor, the smallest hash of its `GRAM`-byte grams, so equal strings meet under one
anchor. Runs of strings with one anchor are segments; segments alone under their anchor go, equal ones are counted once.
The rest is dealt to blocks by anchor, where a suffix array decides which strings occur twice:

* a block's segments are cut into phrases at local minima of a gram hash, which depend on nearby bytes only; phrases reach
  past their end by that neighbourhood, so none is a prefix of another and their order is the order of the bytes;
* the suffix array of the phrase numbers is built by Lyndon grouping (`suffix_array`);
* a string is the bytes up to a phrase boundary and the suffix from there: equal strings are neighbours in the order of
  (these bytes, rank of the suffix) whose common prefix, a range minimum, is long enough.

An anchor with more than `UNIT` distinct segments is salted over several blocks. Such blocks hand on each of their distinct
strings once, with its count, and strings met in two blocks are added up, so nothing is lost and no task takes the whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, col, free, with_field
from .textkernel import BASE, BASE_INVERSE, CHUNK_BYTES, U64, _powers, mix, text_chunks

WIDTH = 200
GRAM = 32
RADIUS = 10
TRIGGER = 6
UNIT = 4096
BLOCK_BYTES = 2 << 20
SECOND = 0xD6E8FEB86659FD93
SECOND_INVERSE = pow(SECOND, -1, 1 << 64)


class Prefixes:
    """Hashes of any substring of some bytes, from running sums."""

    def __init__(self, raw: np.ndarray, base: int = BASE, inverse: int = BASE_INVERSE):
        low = (raw.astype(U64) + U64(1)) * _powers(base, len(raw))
        self.total = np.zeros(len(raw) + 1, U64)
        np.cumsum(low, out=self.total[1:])
        self.inverse = _powers(inverse, len(raw) + 1)

    def raw(self, start: np.ndarray, length) -> np.ndarray:
        return (self.total[start + length] - self.total[start]) * self.inverse[start]

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return mix(self.raw(start, length) + np.asarray(length).astype(U64) * U64(0x9E6C63D0876A9A47))

    def grams(self, n: int) -> np.ndarray:
        return mix((self.total[n:] - self.total[:-n]) * self.inverse[: len(self.total) - n])


def sliding_least(values: np.ndarray, window: int) -> np.ndarray:
    span = 1
    while span * 2 <= window:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = window - span
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def pieces(column: pa.Array, width: int):
    """(first row, byte offset in it, bytes, row offsets); a long row comes in pieces that overlap by width - 1."""
    for row, raw, offs in text_chunks(column):
        if len(raw) <= 2 * CHUNK_BYTES:
            yield row, 0, raw, offs
            continue
        for at in range(0, max(1, len(raw) - width + 1), CHUNK_BYTES):
            part = raw[at : at + CHUNK_BYTES + width - 1]
            yield row, at, part, np.array([0, len(part)])


def segments(raw: np.ndarray, offs: np.ndarray, width: int):
    """(row, start, strings, anchor, hash, places) of the segments: runs of at most width - gram + 1 strings with one anchor.

    `places` is 2 where the anchor's gram leaves the string inside the run and comes again: only such a run may repeat in itself.
    """
    gram = min(GRAM, width)
    most = width - gram + 1
    if len(raw) < width:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(U64), none.astype(U64), none
    sums = Prefixes(raw)
    grams = sums.grams(gram)
    anchor = sliding_least(grams, most)
    fits = np.zeros(len(raw) + 1, np.int64)
    room = np.diff(offs) >= width
    np.add.at(fits, offs[:-1][room], 1)
    np.add.at(fits, offs[1:][room] - width + 1, -1)
    at = np.flatnonzero(np.cumsum(fits)[: len(anchor)] > 0)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(U64), none.astype(U64), none
    value = anchor[at]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(at)))
    places = 1 + np.logical_or.reduceat((grams[at] == value) & ~np.append(new[1:], True), first)
    parts = -(-length // most)
    if (parts > 1).any():  # one gram over and over: the run is cut
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        whole = np.repeat(length, parts)
        first, length, places = np.repeat(first, parts) + k * most, np.minimum(most, whole - k * most), np.repeat(places, parts)
    start = at[first]
    row = np.searchsorted(offs, start, "right") - 1
    return row, start - offs[row], length, value[first], sums.of(start, length + width - 1), places


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of a list of whole numbers in ascending order; the end is smaller than any number.

    First every suffix is grouped by its longest Lyndon prefix. Groups are taken from the highest to the lowest. When one is
    taken, its members are linked to their left neighbours, so that a find gives the previous smaller suffix of each; that
    suffix's prefix grows by the group's, once for each member, and so it moves to the top of its own group, the higher the
    more often. Then groups are put in order without renaming: suffixes are read in ascending order, and each one places
    those that it ends, found by the previous-smaller pointers, at the next free place of their group.
    """
    n = len(text)
    if not n:
        return []
    # Suffix i is called i + 1; 0 is never taken and stops every find.
    symbols = np.asarray(text)
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    begins = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    sizes = np.diff(np.append(begins, n))
    place = np.empty(n + 1, np.int64)
    place[order + 1] = np.arange(n)
    group = np.empty(n + 1, np.int64)
    group[order + 1] = np.repeat(begins, sizes)
    group[0] = -1
    size = np.zeros(n, np.int64)
    size[begins] = sizes
    sa, place, group, size = (order + 1).tolist(), place.tolist(), group.tolist(), size.tolist()
    link = list(range(n + 1))  # of a taken suffix: something to its left
    before = [0] * (n + 1)
    end = n
    while end:
        top = sa[end - 1]
        start = group[top]
        if start == end - 1:
            link[top] = p = top - 1
            while link[p] != p:
                link[p] = p = link[link[p]]
            before[top] = p
            end = start
            g = group[p]
            if p and size[g] > 1:
                size[g] -= 1
                here, there = place[p], g + size[g]
                other = sa[there]
                sa[here], sa[there] = other, p
                place[other], place[p] = here, there
                group[p], size[there] = there, 1
            continue
        members = sa[start:end]
        for i in members:
            link[i] = i - 1
        times: dict[int, int] = {}
        for i in members:
            p = i - 1
            while link[p] != p:
                link[p] = p = link[link[p]]
            before[i] = p
            times[p] = times.get(p, 0) + 1
        times.pop(0, None)
        moved: dict[int, dict[int, list[int]]] = {}
        for p, k in times.items():
            g = group[p]
            if size[g] > 1:
                moved.setdefault(g, {}).setdefault(k, []).append(p)
        for g, by_times in moved.items():
            stop = g + size[g]
            for k in sorted(by_times, reverse=True):
                parents = by_times[k]
                begin = stop - len(parents)
                if begin == g:
                    break
                for there, p in enumerate(parents, begin):
                    here, other = place[p], sa[there]
                    sa[here], sa[there] = other, p
                    place[other], place[p] = here, there
                    group[p] = begin
                size[begin] = len(parents)
                stop = begin
            size[g] = stop - g
        end = start
    free_place = list(range(n))
    placed = [False] * (n + 1)
    placed[0] = True
    at, j = -1, n
    while True:
        while not placed[j]:
            placed[j] = True
            g = group[j]
            sa[free_place[g]] = j
            free_place[g] += 1
            j = before[j]
        at += 1
        if at == n:
            return [i - 1 for i in sa]
        j = sa[at] - 1


def boundaries(sums: Prefixes, offs: np.ndarray) -> np.ndarray:
    """Places whose gram hash is below all within RADIUS to the left, and at most those to the right, inside one row."""
    n = int(offs[-1])
    if n < 2 * RADIUS + TRIGGER:
        return np.zeros(0, np.int64)
    h = sums.grams(TRIGGER)
    side = sliding_least(h, RADIUS)
    t = np.arange(RADIUS, len(h) - RADIUS)
    low = t[(h[t] < side[t - RADIUS]) & (h[t] <= side[t + 1])]
    row = np.searchsorted(offs, low, "right") - 1
    return low[(low - RADIUS >= offs[row]) & (low + RADIUS + TRIGGER <= offs[row + 1])]


def common_prefix(sums: Prefixes, a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of places a and b, `room` at most."""
    lo, hi = np.zeros(len(a), np.int64), room.copy()
    for _ in range(int(room.max(initial=0)).bit_length() + 1):
        mid = (lo + hi + 1) // 2
        same = sums.raw(a, mid) == sums.raw(b, mid)
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


class RangeLeast:
    """Least value of values[a:b] for many ranges, by doubling."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            v, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(v[:-half], v[half:]))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), self.levels[0].dtype)
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        for k in np.unique(level):
            m = level == k
            v = self.levels[k]
            out[m] = np.minimum(v[a[m]], v[b[m] - (1 << k)])
        return out


def string_classes(raw: np.ndarray, offs: np.ndarray, strings: np.ndarray, width: int):
    """(row, place in the row, class) of the first `strings` places of every row: equal classes are equal strings of `width` bytes."""
    one, two = Prefixes(raw), Prefixes(raw, SECOND, SECOND_INVERSE)
    row = np.repeat(np.arange(len(strings)), strings)
    place = np.arange(len(row)) - np.repeat(np.cumsum(strings) - strings, strings)
    at = offs[:-1][row] + place
    cut = boundaries(one, offs)
    reach = RADIUS + TRIGGER
    if len(cut):
        owner = np.searchsorted(offs, cut, "right") - 1
        last = np.append(owner[1:] != owner[:-1], True)
        stop = np.where(last, offs[owner + 1], np.append(cut[1:], 0) + reach)
        data = raw.tobytes()
        phrases = [data[a:b] for a, b in zip(cut.tolist(), stop.tolist(), strict=True)]
        number = {x: i for i, x in enumerate(sorted(set(phrases)), 1)}
        # Rows end with a 0, which is smaller than any phrase.
        where = np.arange(len(cut)) + owner
        text = np.zeros(len(cut) + len(strings), np.int64)
        text[where] = [number[x] for x in phrases]
        order = np.array(suffix_array(text.tolist()))
        phrase_of = np.full(len(text), -1)
        phrase_of[where] = np.arange(len(cut))
        order = phrase_of[order]
        order = order[order >= 0]
        rank = np.empty(len(cut), np.int64)
        rank[order] = np.arange(len(cut))
        end = np.minimum(offs[owner + 1] - cut, width)
        a, b = order[:-1], order[1:]
        shared = RangeLeast(np.r_[0, common_prefix(one, cut[a], cut[b], np.minimum(end[a], end[b]))])
        nearest = np.searchsorted(cut, at + RADIUS)
        ok = nearest < len(cut)
        ok[ok] &= cut[nearest[ok]] + reach <= at[ok] + width
        rest = np.where(ok, cut[np.minimum(nearest, len(cut) - 1)] - at, width)
        suffix = np.where(ok, rank[np.minimum(nearest, len(cut) - 1)], -1)
    else:
        rest, suffix = np.full(len(at), width), np.full(len(at), -1)
    head, check = one.of(at, rest), two.of(at, rest)
    by = np.lexsort((suffix, check, head))
    x, y = by[:-1], by[1:]
    same = (head[x] == head[y]) & (check[x] == check[y])
    deep = np.flatnonzero(same & (suffix[x] >= 0) & (suffix[y] > suffix[x]))
    if len(deep):
        p, q = x[deep], y[deep]
        same[deep] = shared.of(suffix[p] + 1, suffix[q] + 1) >= width - rest[p]
    kind = np.empty(len(at), np.int64)
    kind[by] = np.cumsum(np.r_[True, ~same]) - 1 if len(by) else 0
    return row, place, kind, one.of(at, np.full(len(at), width)), two.of(at, np.full(len(at), width))


DECIDED = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64()), ("n", pa.int64())])


def decide_block(width: int):
    """Of one block of segments: ranges of strings that occur twice in it, and each distinct string of salted anchors."""

    def run(table: pa.Table) -> pa.Table:
        anchor, seg = (table.column(c).to_numpy() for c in ("anchor", "seg"))
        _, keep = np.unique(np.stack([anchor, seg], 1), axis=0, return_index=True)
        table = table.take(pa.array(keep))
        anchor, seg, n, strings, salts = (table.column(c).to_numpy() for c in ("anchor", "seg", "n", "strings", "salts"))
        texts = table.column("bytes").combine_chunks()
        raw = np.frombuffer(b"".join(texts.to_pylist()), np.uint8)
        offs = np.r_[0, np.cumsum(strings + width - 1)]
        row, place, kind, w1, w2 = string_classes(raw, offs, strings, width)
        total = np.bincount(kind, n[row]).astype(np.int64)
        twice = total[kind] >= 2
        edge = np.flatnonzero(twice & np.r_[True, ~twice[:-1] | (row[1:] != row[:-1])])
        stop = np.flatnonzero(twice & np.r_[~twice[1:] | (row[1:] != row[:-1]), True])
        _, one_each = np.unique(kind, return_index=True)
        hot = one_each[salts[row[one_each]] > 1]
        i = np.r_[row[edge], row[hot]]
        null = np.r_[np.ones(len(edge), bool), np.zeros(len(hot), bool)]
        w = [pa.array(np.r_[np.zeros(len(edge), np.int64), x[hot].view(np.int64)], mask=null) for x in (w1, w2)]
        columns = [anchor[i], seg[i], np.r_[place[edge], place[hot]].astype(np.int32), np.r_[place[stop], place[hot]].astype(np.int32), *w, np.r_[np.zeros(len(edge), np.int64), total[kind[hot]]]]
        return pa.Table.from_arrays([pa.array(c) for c in columns], schema=DECIDED)

    return run


def _found(width: int):
    names = ["k1", "k2", "anchor", "seg", "start", "strings", "places"]

    def run(batches):
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            for first, at, raw, offs in pieces(batch.column(2), width):
                row, start, strings, anchor, seg, places = segments(raw, offs, width)
                if len(row):
                    cols = (k1[first + row], k2[first + row], anchor.view(np.int64), seg.view(np.int64), start + at, strings.astype(np.int32), places.astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    return run


def _slices(width: int):
    names = ["anchor", "seg", "n", "salts", "strings", "bytes"]

    def run(batches):
        for batch in batches:
            picks = batch.column(1)
            fields = {f.name: picks.flatten().field(i) for i, f in enumerate(picks.type.value_type)}
            counts = np.diff(np.asarray(picks.offsets))
            owner = np.repeat(np.arange(len(counts)), counts)
            start, strings = np.asarray(fields["start"]), np.asarray(fields["strings"])
            texts = batch.column(0).cast(pa.binary())
            out, size, since = [], 0, 0
            text, of = b"", -1
            for i, (r, s, m) in enumerate(zip(owner.tolist(), start.tolist(), strings.tolist(), strict=True)):
                if r != of:
                    text, of = texts[r].as_py(), r
                out.append(text[s : s + m + width - 1])
                size += m + width
                if size > 8 << 20 or i + 1 == len(owner):
                    cols = [fields[c].slice(since, len(out)) for c in names[:-1]]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.binary())], names)
                    out, size, since = [], 0, i + 1

    return run


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of ranges that touch or overlap."""
    by = np.argsort(starts, kind="stable")
    starts, ends = starts[by], np.maximum.accumulate(ends[by]) if len(by) else ends
    new = np.r_[True, starts[1:] > ends[:-1]] if len(by) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return starts[at], ends[np.append(at[1:], len(by)) - 1] if len(at) else ends


SPAN = pa.struct([("first", pa.int64()), ("last", pa.int64())])


def _removed(text: str, ranges: str):
    def run(batches):
        for batch in batches:
            names = batch.schema.names
            texts, spans = batch.column(names.index(text)).cast(pa.binary()), batch.column(names.index(ranges))
            rows = []
            for t, r in zip(texts, spans, strict=True):
                t = t.as_py() or b""
                r = np.array([(x["first"], x["last"]) for x in r.as_py() or ()], np.int64).reshape(-1, 2)
                a, b = (x.tolist() for x in merged(r[:, 0], r[:, 1]))
                kept = b"".join(t[x:y] for x, y in zip([0, *b], [*a, len(t)], strict=True))
                rows.append({"n_bytes": len(t), "spans": [{"first": x, "last": y} for x, y in zip(a, b, strict=True)], "kept": kept})
            kind = pa.struct([("n_bytes", pa.int64()), ("spans", pa.list_(SPAN)), ("kept", pa.binary())])
            keep = [i for i, n in enumerate(names) if n != ranges]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(rows, kind)], [*(names[i] for i in keep), "result"])

    return run


def result_column(docs: DataFrame) -> str:
    return free("__repeats", docs.columns)


def remove_repeats(spark: SparkSession, docs: DataFrame, width: int = WIDTH, unit: int = UNIT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with a struct `__repeats`: n_bytes, spans (maximal removed runs, ends exclusive) and the bytes kept.

    A byte goes if some string of `width` bytes over it also starts anywhere else, in the same text or another one. Texts
    are UTF-8 bytes, judged as they came in; null is empty; texts shorter than `width` keep all bytes. Rows equal in id and
    text repeat each other, so all their bytes go where they are long enough. Ids are of any type, null too; an empty table
    gives none; columns of any name may stand beside `doc_id` and `text`.
    """
    box, result = Scratch(spark, "repeats"), result_column(docs)
    text, id_ = col("text"), col("doc_id")
    keys = (F.xxhash64(text, id_), F.xxhash64(F.lit(7), id_, text))
    keyed = docs.select(keys[0].alias("k1"), keys[1].alias("k2"), F.coalesce(text, F.lit("")).alias("text")).where(F.octet_length("text") >= width)
    rows = keyed.mapInArrow(_found(width), "k1 bigint, k2 bigint, anchor bigint, seg bigint, start bigint, strings int, places int")
    again = rows.groupBy("anchor").agg(F.sum("places").alias("c")).where("c > 1").select("anchor")
    again = box.save(again)  # read behind an exchange of its own, so that a hot anchor's rows can be split
    met = box.save(rows.drop("places").join(again, "anchor", "left_semi"))
    classes = met.groupBy("anchor", "seg").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "start", "strings")).alias("at"))
    size = classes.groupBy("anchor").agg(F.count("*").alias("segs"), F.sum(F.col("at.strings") + width - 1).alias("bytes"))
    classes = box.save(classes.join(size, "anchor").select("anchor", "seg", "n", "at.*", F.ceil(F.col("segs") / unit).cast("int").alias("salts")))
    total = classes.agg(F.sum(F.col("strings") + width - 1)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    picks = classes.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "seg", "n", "salts", "start", "strings")).alias("picks"))
    cut = picks.join(keyed, ["k1", "k2"]).select("text", "picks").mapInArrow(_slices(width), "anchor bigint, seg bigint, n bigint, salts int, strings int, bytes binary")
    block = F.pmod(F.xxhash64("anchor", F.pmod("seg", "salts")), F.lit(blocks)).alias("block")
    kinds = {"int64": "bigint", "int32": "int"}
    decided = box.save(cut.select(block, "*").groupBy("block").applyInArrow(decide_block(width), ", ".join(f"`{f.name}` {kinds[str(f.type)]}" for f in DECIDED)))
    # Strings of salted anchors: those of two blocks are added up.
    spread = decided.where("w1 is not null").withColumn("all", F.sum("n").over(W.partitionBy("w1", "w2"))).where("all > 1")
    ranges = decided.where("w1 is null").unionByName(spread.drop("all")).select("anchor", "seg", F.col("first").alias("lo"), F.col("last").alias("hi"))
    covered = met.join(ranges, ["anchor", "seg"]).select("k1", "k2", F.struct((F.col("start") + F.col("lo")).alias("first"), (F.col("start") + F.col("hi") + width).alias("last")).alias("r"))
    found = covered.groupBy("k1", "k2").agg(F.collect_set("r").alias("found"))
    a, b, r = (free(x, docs.columns) for x in ("k1_", "k2_", "found_"))
    both = docs.withColumns({a: keys[0], b: keys[1]}).join(found.select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("found").alias(r)), [a, b], "left").drop(a, b)
    own = {c: f"c{k}" for k, c in enumerate(both.columns)}
    flat = both.toDF(*own.values())
    kept = "struct<n_bytes: bigint, spans: array<struct<first: bigint, last: bigint>>, kept: binary>"
    schema = with_field(flat.drop(own[r]).schema, "result", kept)
    return flat.mapInArrow(_removed(own[next(c for c in docs.columns if c.lower() == "text")], own[r]), schema).toDF(*docs.columns, result)
