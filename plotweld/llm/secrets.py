"""Secret scan by fixed patterns and a randomness test battery, in DataFrame operations only.

Base spans are the patterns of `BASE`, leftmost and not overlapping per kind. The battery adds
spans: candidates are all long runs, with digits or without; each gets the narrowest encoding whose
alphabet holds it, and against "uniform over this alphabet" three tests: chi-squared of the
symbol counts, runs of the upper and lower half of the alphabet, and lag-one serial correlation
of the symbol values. A candidate must pass all three (least p-value times three of at least
`CONSISTENT`).

Passing alone favours short strings, which tests can hardly reject. So each candidate also gets
a p-value for "written as prose or as an identifier": the likelihood ratio of PROSE against the uniform
model is an e-value, its inverse a p-value by Markov's inequality, which falls with length. Over
all candidates of the corpus, in strata by length, Benjamini-Hochberg at `RATE` decides; p-values are
counted in tenths of a decimal order, rounded up, so the table of counts has a fixed size. So the two steps combine by
"and": the battery rejects what is not random within its encoding, false-discovery control what prose explains.

Offsets are code points, end exclusive; the span of an assignment is its whole match. Null text
counts as empty. Every row is scanned for itself: repeated rows and null ids need no care.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Fixed patterns: kind, pattern, least length and the group it is of.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    ("access", r"AKIA[A-Z0-9]+", 20),
    ("hex", r"[0-9a-f]+", 24),
)
#: The same kinds as quick tests: what a text must hold for any match that passes.
QUICK = {"assign": BASE[0][1], "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+"
#: Fixed alphabets, narrowest first.
ALPHABETS = (
    ("digits", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("lower", "abcdefghijklmnopqrstuvwxyz"),
    ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("upper36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("any", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
#: Fixed shares of characters in words and identifiers, per cent: letters of English by falling frequency, then the rest.
PROSE = {
    "e": 11.4, "t": 8.2, "a": 7.4, "o": 6.8, "i": 6.3, "n": 6.3, "s": 5.7, "h": 5.5, "r": 5.4, "d": 3.9, "l": 3.6, "c": 2.5, "u": 2.5, "m": 2.2, "w": 2.1,
    "f": 2.0, "g": 1.8, "y": 1.8, "p": 1.7, "b": 1.4, "v": 0.9, "k": 0.7, "j": 0.14, "x": 0.14, "q": 0.09, "z": 0.07,
}
UPPER_SHARE, DIGIT_SHARE, MARK_SHARE = 0.15, 0.55, 0.5
CONSISTENT, RATE = 0.01, 0.001
STRATA = (16, 24, 32, 48, 96)
BINS = 400


def prefix_sums(a: Column, block: int = 256) -> Column:
    """For each index the sum of the entries before it, in blocks: no array is copied for an entry."""
    zero = F.lit(0)
    plus = lambda x, y: x + y
    n = F.size(a)
    blocks = F.transform(F.sequence(zero, F.floor(n / block).cast("int")), lambda b: F.aggregate(F.slice(a, b * block + 1, block), zero, plus))
    before = lambda sums, i: F.aggregate(F.slice(sums, 1, F.floor(i / block).cast("int")), zero, plus) + F.aggregate(F.slice(a, F.floor(i / block).cast("int") * block + 1, i % block), zero, plus)
    return let(blocks, lambda sums: F.transform(a, lambda x, i: before(sums, i)))


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once for a row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def located(text: Column, pattern: str, group: int, quick: str) -> Column:
    """array<struct<at, len, part>> of the matches of a pattern; `part` is the group's text."""
    p = F.lit(pattern)
    size = lambda a: F.transform(a, lambda x: F.length(x))
    parts = F.regexp_extract_all(text, p, F.lit(group))
    pieces = F.struct(size(F.regexp_extract_all(text, p, F.lit(0))).alias("lens"), size(F.split(text, pattern, -1)).alias("gaps"), parts.alias("parts"))

    def starts(v: Column) -> Column:
        gaps = F.slice(v["gaps"], 1, F.size(v["lens"]))
        return let(F.zip_with(gaps, v["lens"], lambda g, m: g + m), lambda steps: F.zip_with(prefix_sums(steps), gaps, lambda s, g: s + g))

    found = let(pieces, lambda v: F.transform(F.arrays_zip(starts(v).alias("s"), v["lens"].alias("l"), v["parts"].alias("p")), lambda x: F.struct(x["s"].alias("at"), x["l"].alias("len"), x["p"].alias("part"))))
    return F.when(text.rlike(quick), found).otherwise(F.array().cast("array<struct<at:int,len:int,part:string>>"))


def normal_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by a rational approximation good to 1e-7."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _serial(v: Column, n: Column) -> Column:
    """Lag-one serial correlation of the values `v`; 1 where they do not vary."""
    first, last = F.element_at(v, 1), F.element_at(v, -1)
    sums = F.aggregate(
        v,
        F.struct(F.lit(0.0).alias("last"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), F.lit(0.0).alias("c")),
        lambda acc, x: F.struct(x.alias("last"), (acc["s"] + x).alias("s"), (acc["q"] + x * x).alias("q"), (acc["c"] + acc["last"] * x).alias("c")),
    )

    def result(a: Column) -> Column:
        mean = a["s"] / n
        spread = a["q"] - a["s"] * mean
        return F.when(spread > 0, (a["c"] - mean * (2 * a["s"] - first - last) + (n - 1) * mean * mean) / spread).otherwise(1.0)

    return let(sums, result)


def _tests(token: Column, alphabet: Column) -> Column:
    """The least of the three p-values, times three."""
    n, k = F.length(token).cast("double"), F.length(alphabet).cast("double")
    squares = F.aggregate(F.split(alphabet, ""), F.lit(0.0), lambda acc, c: acc + F.pow(n - F.length(F.replace(token, c, F.lit(""))), 2))
    chi = (squares * k / n - n - (k - 1)) / F.sqrt(2.0 * (k - 1) * (n - 1) / n)
    half = F.floor(k / 2).cast("int")
    bits = F.call_function("translate", token, alphabet, F.concat(F.repeat(F.lit("0"), half), F.repeat(F.lit("1"), k.cast("int") - half)))

    def z_runs(b: Column) -> Column:
        turns = n - F.length(F.replace(b, F.lit("01"), F.lit("x"))) + n - F.length(F.replace(b, F.lit("10"), F.lit("x")))
        return let(F.length(F.replace(b, F.lit("0"), F.lit(""))).cast("double"), lambda ones: let(ones * (n - ones), lambda m: F.when(2 * m > n, (turns - 2 * m / n) / F.sqrt(2 * m * (2 * m - n) / (n * n * (n - 1)))).otherwise(F.lit(9.0))))

    serial = let(F.transform(F.split(token, ""), lambda c: F.instr(alphabet, c).cast("double")), lambda v: _serial(v, n))
    z = F.array(chi, F.abs(let(bits, z_runs)), F.abs((serial + 1 / n) * F.sqrt(n)))
    return F.least(F.lit(1.0), 3 * F.array_min(F.transform(z, lambda x, i: F.when(i == 0, 1.0).otherwise(2.0) * normal_tail(x))))


def battery(token: Column) -> Column:
    """(p_random, log_p): randomness tests in the narrowest encoding, and log p-value of prose."""
    chars = [(c, v / 100 * (1 - UPPER_SHARE) * (1 - DIGIT_SHARE / 10)) for c, v in PROSE.items()]
    chars += [(c.upper(), v / 100 * UPPER_SHARE) for c, v in PROSE.items()] + [(str(d), DIGIT_SHARE / 100) for d in range(10)] + [(c, MARK_SHARE / 100) for c in "+/-_"]
    table = F.lit("".join(c for c, _ in chars))
    logs = F.array(*(F.lit(math.log(v)) for _, v in chars))
    options = None
    for _, alphabet in ALPHABETS:
        fits = F.length(F.translate(token, alphabet, "")) == 0
        options = F.when(fits, F.lit(alphabet)) if options is None else options.when(fits, F.lit(alphabet))
    prose = F.aggregate(F.split(token, ""), F.lit(0.0), lambda s, c: s + F.element_at(logs, F.instr(table, c)))
    return let(options, lambda a: F.struct(_tests(token, a).alias("p_random"), F.least(F.lit(0.0), prose + F.length(token) * F.log(F.length(a).cast("double"))).alias("log_p")))


def _spans(hits: Column, order: int, kind: str, least: int) -> Column:
    good = F.filter(hits, lambda x: F.length(x["part"]) >= least)
    return F.transform(good, lambda x: F.struct(x["at"].alias("at"), F.lit(order).alias("o"), F.lit(kind).alias("kind"), (x["at"] + x["len"]).alias("end")))


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Base spans and tested candidates of each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    for order, (kind, pattern, least) in enumerate(BASE):
        hits = located(F.col("text"), pattern, 2 if kind == "assign" else 0, QUICK[kind])
        rows = rows.withColumn(kind, _spans(hits, order, kind, least))
    rows = rows.withColumn("candidates", located(F.col("text"), CANDIDATE, 0, CANDIDATE)).drop("text")
    tested = F.transform("candidates", lambda x: F.struct(x["at"].alias("at"), (x["at"] + x["len"]).alias("end"), battery(x["part"]).alias("b")))
    stratum = lambda n: sum((F.when(n >= s, 1).otherwise(0) for s in STRATA[1:]), F.lit(0))
    order = lambda x: F.least(F.lit(BINS), F.floor(-x["b"]["log_p"] / 2.302585092994046 * 10)).cast("int")
    tests = F.transform(tested, lambda x: F.struct(x["at"].alias("at"), x["end"].alias("end"), stratum(x["end"] - x["at"]).alias("stratum"), order(x).alias("bin"), x["b"]["p_random"].alias("p_random")))
    return rows.select("doc_id", *(k for k, _, _ in BASE), F.when(F.size("candidates") > 0, tests).otherwise(F.array().cast("array<struct<at:int,end:int,stratum:int,bin:int,p_random:double>>")).alias("tests"))


def least_bins(counts: dict[int, dict[int, int]], rate: float) -> dict[int, int]:
    """Benjamini-Hochberg on binned p-values: for each stratum the lowest bin of evidence that passes."""
    out = {}
    for stratum, bins in counts.items():
        total, above, best = sum(bins.values()), 0, BINS + 1
        for b in sorted(bins, reverse=True):
            above += bins[b]
            if total * 10.0 ** (-b / 10) <= rate * above:
                best = b
        out[stratum] = best
    return out


def secret_scan(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """One row per row: doc_id and arrays `base` and `added` of structs at, o, kind, end."""
    box = Scratch(spark, "secrets")
    rows = box.save(scanned(docs, id_col, text_col))
    counts: dict[int, dict[int, int]] = {}
    for r in rows.select(F.explode("tests").alias("t")).groupBy("t.stratum", "t.bin").count().collect():
        counts.setdefault(r[0], {})[r[1]] = r[2]
    bins = least_bins(counts, rate)
    passes = F.array(*(F.lit(bins.get(s, BINS + 1)) for s in range(len(STRATA))))
    base = F.concat(*(F.col(k) for k, _, _ in BASE))
    good = lambda x: (x["p_random"] >= CONSISTENT) & (x["bin"] >= F.element_at(passes, x["stratum"] + 1))
    clear = lambda x: ~F.exists("base", lambda b: (b["at"] < x["end"]) & (x["at"] < b["end"]))
    added = F.transform(F.filter(F.filter("tests", good), clear), lambda x: F.struct(x["at"].alias("at"), F.lit(len(BASE)).alias("o"), F.lit("random").alias("kind"), x["end"].alias("end")))
    return rows.withColumn("base", F.array_sort(base)).withColumn("added", added).select("doc_id", "base", "added", *(F.size(k).cast("bigint").alias(f"n_{k}") for k, _, _ in BASE))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["at"].cast("string"), x["end"].cast("string"))), ",")
