"""Line deduplication by a deletion-neighbourhood join, in DataFrame operations only.

A line goes if it repeats an earlier one exactly, or if an earlier line lies within one edit of
it (insertion, deletion or substitution of a character). Earlier is by doc_id, then line number.
Lines of fewer than `min_chars` characters are never compared: MIN_CHARS by default; 1, as in the query and the pipeline,
compares every line that is not blank, exactly and by edits.

All one-character deletion variants of all lines would be as many keys as the corpus has characters, so two
exact filters come first; neither loses a pair within one edit:

1. halves: with g from a fixed grid, g at most half of the shorter length, such lines share
   their first g or their last g characters. A line whose keys nobody shares has no partner.
2. segments: a line of n characters in ceil(sqrt(n)) wide segments; such lines agree but for one
   segment. A (line, segment) whose remainder nobody shares is left out.

The hash of a remainder is put together from the hashes of the segments before and behind, so a row carries one segment
and never the line: work and rows grow with a line's length, not faster. What is left emits its deletion variants, inside
the shared segments, as hashed keys of remainder and shortened segment. With the position in
the key, lines of equal length under one key differ by one substitution at most; a shorter line
equals a variant of a longer one. So the earliest line under a key is a witness for the others:
a minimum with map-side combining finds it, no pairs of a group are made. Before a line goes, it is compared with its
witness, less the character at the place that the key names.

Exact repeats are told by two hashes of the line and its length. Null text stays null, empty text has one empty line
that stays. Rows equal in doc_id and text count as one document and keep the same lines. Ids are whole numbers
(or cast to them); null ones come last. Other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, col, free

MIN_CHARS = 20
LAST = (1 << 63) - 1
GRID = [m * 2**k // 2 for k in range(2, 26) for m in (2, 3)]


def _grid(half: Column) -> Column:
    """The largest value 2**k or 1.5 * 2**k that is at most `half`; 0 for 0."""
    power = F.pow(F.lit(2.0), F.floor(F.log2(half.cast("double")))).cast("int")
    return F.when(half < 1, 0).when(half >= power + F.floor(power / 2), power + F.floor(power / 2)).otherwise(power).cast("int")


def _halves(line: Column, n: Column, shorter: Column) -> tuple[Column, Column]:
    g = _grid(F.floor(shorter / 2))
    return F.xxhash64(F.lit("p"), g, F.substring(line, F.lit(1), g)), F.xxhash64(F.lit("s"), g, F.substring(line, n - g + 1, g))


def _without(line: Column, at: Column) -> Column:
    """The line without the character at offset `at` (from 0)."""
    return F.concat(F.substring(line, F.lit(1), at), F.substring(line, at + 2, F.length(line)))


def _width(longer: Column) -> Column:
    return F.ceil(F.sqrt(longer.cast("double"))).cast("int")


def _pieces(line: Column, width: Column) -> Column:
    """The line in pieces of `width` characters, in one pass."""
    return F.regexp_extract_all(line, F.concat(F.lit("(?s).{1,"), width.cast("string"), F.lit("}")), F.lit(0))


def _mixed(hashes: Column) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x))


def _once(value: Column, f) -> Column:
    """f of a value that is computed once: what a lambda names by a column may be computed again for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _segment_keys(lines: DataFrame, long: bool) -> DataFrame:
    """A key for each segment of each line: its number, what the line counts as, and the hash of the other segments."""
    return lines.select("lid", "m", F.posexplode("rests").alias("seg", "rest")).select("lid", "seg", F.lit(long).alias("long"), F.xxhash64("m", "seg", "rest").alias("key"))


def _chosen(lines: DataFrame, segs: str) -> DataFrame:
    """Rows of the segments named by a column."""
    out = lines.select("first", "m", "w", segs, F.posexplode(F.arrays_zip("rests", "pieces")).alias("seg", "x")).where(F.array_contains(segs, F.col("seg")))
    return out.select("first", "m", "w", "seg", F.col("x.rests").alias("rest"), F.coalesce("x.pieces", F.lit("")).alias("piece"))


def _long_segments(lines: DataFrame) -> DataFrame:
    """The segments of each line and, for each, the hash of the others."""
    cut = lines.withColumns({"m": F.col("n"), "w": _width(F.col("n"))}).withColumn("pieces", _pieces(F.col("line"), F.col("w")))
    others = lambda hashes: _once(_mixed(hashes), lambda every: F.transform(hashes, lambda x: every.bitwiseXOR(x)))
    return cut.withColumn("rests", _once(F.transform("pieces", lambda s, i: F.xxhash64(i, s)), others))


def _short_segments(lines: DataFrame) -> DataFrame:
    """The same for a line taken as one of a character more that has lost one in the segment: what follows it is set off by one."""
    cut = lines.withColumns({"m": F.col("n") + 1, "w": _width(F.col("n") + 1)})
    cut = cut.withColumns({"whole": _pieces(F.col("line"), F.col("w")), "later": _pieces(F.substring("line", F.col("w"), F.length("line")), F.col("w")), "k": F.ceil(F.col("m") / F.col("w")).cast("int")})

    def rests(before: Column, behind: Column) -> Column:
        # Behind a segment j come those numbered from j + 1, the first of `behind` being number 1.
        rest = lambda j: _mixed(F.slice(before, F.lit(1), j)).bitwiseXOR(_mixed(F.slice(behind, j + 1, F.size(behind))))
        return F.transform(F.sequence(F.lit(0), F.col("k") - 1), rest)

    both = _once(F.transform("whole", lambda s, i: F.xxhash64(i, s)), lambda a: _once(F.transform("later", lambda s, i: F.xxhash64(i + 1, s)), lambda b: rests(a, b)))
    return cut.withColumns({"rests": both, "pieces": F.transform("whole", lambda s: F.substring(s, F.lit(1), F.col("w") - 1))})


def line_occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    base = docs.where(F.col(text_col).isNotNull()).select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("o"), F.xxhash64(text_col).alias("dh"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line")
    )
    lines = base.withColumn("n", F.length("line")).where((F.col("n") >= min_chars) & ((F.col("n") >= MIN_CHARS) | F.col("line").rlike(r"\S")))
    line, n = F.col("line"), F.col("n")
    a, b = _halves(line, n, n), _halves(line, n, n - 1)
    return lines.select("o", "dh", "pos", F.xxhash64("line").alias("h"), "n", F.xxhash64(F.lit("second"), "line").alias("h2"), F.array_distinct(F.array(*a, *b)).alias("halves"))


def dropped_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(o, dh, drops): for each document that loses lines, their numbers from 0."""
    min_chars = max(1, min_chars)
    box = Scratch(spark, "lines")
    seen = box.save(line_occurrences(docs, id_col, text_col, min_chars))
    first = F.struct("o", "pos", "dh")
    distinct = box.save(seen.groupBy("h", "n", "h2").agg(F.min(first).alias("first"), F.count("*").alias("count"), F.first("halves").alias("halves")))

    keys = distinct.select("h", "n", "first", F.explode("halves").alias("key"))
    common = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    some = keys.join(common, "key", "left_semi").select("h", "n", "first").distinct()
    by_doc = some.groupBy(F.col("first.o").alias("so"), F.col("first.dh").alias("sdh")).agg(F.collect_list(F.struct(F.col("first.pos").alias("pos"), "h", "n")).alias("want"))
    text = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("o"), F.xxhash64(text_col).alias("dh"), F.col(text_col).alias("text"))
    texts = text.join(by_doc, (F.col("o") == F.col("so")) & (F.col("dh") == F.col("sdh")))
    texts = texts.select("o", "dh", F.split("text", "\n", -1).alias("lines"), "want").select("o", "dh", F.explode(F.transform("want", lambda w: F.struct(w["h"].alias("h"), w["n"].alias("n"), w["pos"].alias("pos"), F.element_at("lines", w["pos"] + 1).alias("line")))).alias("x"))
    lines = box.save(texts.select("x.h", "x.n", F.struct(F.col("o").alias("o"), F.col("x.pos").alias("pos"), F.col("dh").alias("dh")).alias("first"), "x.line").distinct().withColumn("lid", F.monotonically_increasing_id()))

    parts = _segment_keys(_long_segments(lines), True).unionByName(_segment_keys(_short_segments(lines), False))
    shared = parts.groupBy(F.col("key").alias("shared")).agg(F.count("*").alias("c"), F.max("long").alias("any")).where("c > 1 and any").select("shared")
    live = parts.join(shared, F.col("key") == F.col("shared"), "left_semi").groupBy("lid").agg(*(F.collect_set(F.when(F.col("long") == k, F.col("seg"))).alias(c) for k, c in ((True, "as_long"), (False, "as_short"))))
    found = lines.join(live.withColumnRenamed("lid", "live"), F.col("lid") == F.col("live"))
    places = F.explode(F.sequence(F.lit(0), F.length("piece") - 1)).alias("q")
    cut = _chosen(_long_segments(found), "as_long").select("first.*", "m", (F.col("seg") * F.col("w")).alias("at"), "seg", "rest", "piece", places)
    variant = F.concat(F.substring("piece", F.lit(1), F.col("q")), F.substring("piece", F.col("q") + 2, F.length("piece")))
    cut = cut.select("o", "pos", "dh", (F.col("at") + F.col("q")).alias("p"), F.xxhash64("m", "seg", "rest", variant).alias("v"))
    # Kinds: 0 a line of equal length, 1 the longer of two, 2 the shorter.
    longs = cut.select("o", "pos", "dh", "p", F.posexplode(F.array(F.xxhash64(F.lit("s"), "p", "v"), F.xxhash64(F.lit("d"), "v"))).alias("kind", "key"))
    shorts = _chosen(_short_segments(found), "as_short").select("first.*", F.lit(-1).alias("p"), F.lit(2).alias("kind"), F.xxhash64(F.lit("d"), F.xxhash64("m", "seg", "rest", "piece")).alias("key"))
    variants = longs.unionByName(shorts)
    least = variants.groupBy("key").agg(F.count("*").alias("c"), *(F.min(F.when(F.col("kind") == k, F.struct("o", "pos", "dh", "p"))).alias(f"w{k}") for k in range(3))).where("c > 1").drop("c")
    witness = F.when(F.col("kind") == 0, F.col("w0")).when(F.col("kind") == 1, F.col("w2")).otherwise(F.col("w1"))
    near = variants.join(least, "key").select(F.struct("o", "pos", "dh").alias("first"), "kind", F.greatest(F.col("p"), witness["p"]).alias("p"), F.struct(*(witness[c].alias(c) for c in ("o", "pos", "dh"))).alias("witness")).where("witness.o is not null and witness < first")
    near = near.groupBy("first").agg(F.min(F.struct("witness", "kind", "p")).alias("w")).select("first", "w.*")
    mine = lines.select(F.col("h").alias("ah"), F.col("first").alias("af"), F.col("line").alias("a"))
    its = lines.select(F.col("first").alias("bf"), F.col("line").alias("b"))
    # `first` tells distinct lines apart where they share a hash.
    checked = near.join(mine, F.col("first") == F.col("af")).join(its, F.col("witness") == F.col("bf"))
    less = lambda c: _without(F.col(c), F.col("p"))
    same = F.when(F.col("kind") == 0, (F.length("a") == F.length("b")) & (less("a") == less("b"))).when(F.col("kind") == 1, less("a") == F.col("b")).otherwise(F.col("a") == less("b"))
    checked = checked.where(same).select(F.col("ah").alias("gone"), F.col("first").alias("gf"))

    twice = distinct.join(checked, (distinct.h == checked.gone) & (distinct["first"] == checked["gf"]), "left").where("count > 1 or gone is not null")
    twice = box.save(twice.select(F.col("h").alias("th"), F.col("n").alias("tn"), F.col("h2").alias("t2"), F.col("first").alias("tf"), F.col("gone").isNotNull().alias("all")))
    drops = seen.select("o", "dh", "pos", "h", "n", "h2").join(twice, (F.col("h") == F.col("th")) & (F.col("n") == F.col("tn")) & (F.col("h2") == F.col("t2")))
    drops = drops.where(F.col("all") | (F.struct("o", "pos", "dh") != F.col("tf")))
    return drops.groupBy("o", "dh").agg(F.collect_set("pos").alias("drops"))


def lines_column(docs: DataFrame) -> str:
    """The name of the struct of line counts beside the columns of `docs`."""
    return free("__lines", docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows of `docs` with `text` less its repeated lines, and a struct `__lines` of n_lines and n_dropped (see `lines_column`).

    Where there is a column n_chars it is brought up to date.
    """
    gone = dropped_lines(spark, docs.select(col(id_col).alias("id"), col(text_col).alias("text")), "id", "text", min_chars)
    # Own names for the input's columns: none clashes with those added here.
    own = dict(zip(docs.columns, (f"c{k}" for k in range(len(docs.columns))), strict=True))
    rows, text_in = docs.toDF(*own.values()), F.col(own[text_col])
    key = (F.coalesce(F.col(own[id_col]).cast("bigint"), F.lit(LAST)) == F.col("o")) & (F.xxhash64(text_in) == F.col("dh"))
    out = rows.join(gone, key, "left").withColumn("parts", F.split(text_in, "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("drops"))
    text = F.when(F.col("drops").isNull(), text_in).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at("parts", i + 1)), "\n"))
    n_lines, n_dropped = (F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("bigint") for c in ("parts", "drops"))
    out = out.withColumn("kept_text", text).withColumn("counts", F.struct(n_lines.alias("n_lines"), n_dropped.alias("n_dropped")))
    value = lambda c: F.col("kept_text") if c == text_col else F.length("kept_text").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(own[c])
    return out.select(*(value(c).alias(c) for c in docs.columns), F.col("counts").alias(lines_column(docs)))
