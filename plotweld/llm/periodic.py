"""Periodic runs of words: maximal stretches whose words repeat with a period, found on a harmonic grid.

A run of period p and length max(6, 4 p) or more holds two words p apart at some grid point of step max(6, 4 p) - p, so
the grid of all periods has about n ln(n) / 3 points for n words. All (period, grid point) pairs of a stretch of documents are
taken at once: pairs of unlike words go, common extensions of the others to the right and the left are found by binary search on
prefix hashes, and what is long enough is a run. Its words are compared themselves; should one differ, the document is done
again with other hashes. The same run comes from many points and from multiples of its period: the least period stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, free, with_field
from .textkernel import BASE, U64, _powers, text_chunks, word_bounds, word_hashes

LEAST_WORDS = 6
LEAST_PERIODS = 4
PAIRS_AT_ONCE = 1 << 21


def grid(sizes: np.ndarray, pairs_at_once: int = PAIRS_AT_ONCE):
    """(document, period, grid point) of all pairs of documents of `sizes` words, some at a time."""
    longest = sizes // LEAST_PERIODS
    longest = np.where(sizes >= LEAST_WORDS, np.maximum(longest, 1), 0)
    doc = np.repeat(np.arange(len(sizes)), longest)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(longest) - longest, longest) + 1
    step = np.maximum(LEAST_WORDS, LEAST_PERIODS * period) - period
    points = -(-(sizes[doc] - period) // step)
    ends = np.cumsum(points)
    at = 0
    while at < len(doc):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + pairs_at_once, "right")))
        n = points[at:stop]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(doc[at:stop], n), np.repeat(period[at:stop], n), k * np.repeat(step[at:stop], n)
        at = stop


def extension(total: np.ndarray, a: np.ndarray, b: np.ndarray, room: np.ndarray, factor, back: bool = False) -> np.ndarray:
    """How many words from a and b > a on (or before them) are the same, `room` at most, by binary search on running sums."""
    lo, hi = np.zeros(len(a), np.int64), room.copy()
    for _ in range(int(room.max(initial=0)).bit_length() + 1):
        mid = (lo + hi + 1) // 2
        if back:
            same = (total[a] - total[a - mid]) * factor == total[b] - total[b - mid]
        else:
            same = (total[a + mid] - total[a]) * factor == total[b + mid] - total[b]
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


def chunk_runs(words: np.ndarray, first: np.ndarray):
    """(document, start, length, period) of the runs of word hashes, by document, start and period; `first`: first word of each document, one more at the end."""
    sizes = np.diff(first)
    total = np.zeros(len(words) + 1, U64)
    np.cumsum(words * _powers(BASE, len(words)), out=total[1:])
    found = []
    for doc, period, point in grid(sizes):
        a = first[doc] + point
        b = a + period
        like = np.flatnonzero(words[a] == words[b])
        if not len(like):
            continue
        doc, period, a, b = doc[like], period[like], a[like], b[like]
        factor = _powers(BASE, int(period.max()) + 1)[period]
        right = extension(total, a, b, first[doc + 1] - b, factor)
        left = extension(total, a, b, a - first[doc], factor, back=True)
        length = left + right + period
        good = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
        found.append(np.stack([doc, (a - left) - first[doc], length, period], 1)[good])
    runs = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    runs = runs[np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1], runs[:, 0]))]
    same = (runs[1:, :3] == runs[:-1, :3]).all(1)
    runs = runs[np.r_[True, ~same][: len(runs)]]
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def holds(words: list[bytes], runs: list) -> bool:
    return all(words[s : s + n - p] == words[s + p : s + n] for s, n, p in runs)


def exact_runs(text: bytes, words: list[bytes]) -> list:
    """Runs of one document whose hashes met by chance, with other hashes until the words themselves agree."""
    base = BASE
    raw = np.frombuffer(text, np.uint8)
    s, e, first = word_bounds(raw, np.array([0, len(raw)]))
    while True:
        base = (base * 6364136223846793005 + 1442695040888963406) % (1 << 64) | 1
        runs = chunk_runs(word_hashes(raw, s, e, False, base, pow(base, -1, 1 << 64)), first)[:, 1:].tolist()
        if holds(words, runs):
            return runs


def kept_words(words: list[bytes], runs: list) -> list[bytes]:
    """Without the words of a run after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for s, n, p in runs:
        gone[s + p] += 1
        gone[s + n] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _found(text: str):
    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            n_words, all_runs, collapsed = [], [], []
            for _, raw, offs in text_chunks(column):
                s, e, first = word_bounds(raw, offs)
                runs = chunk_runs(word_hashes(raw, s, e, False), first)
                edges = np.searchsorted(runs[:, 0], np.arange(len(offs)))
                rows, data = runs[:, 1:].tolist(), raw.tobytes()
                for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
                    words = data[a:b].split()
                    own = rows[edges[i] : edges[i + 1]]
                    if own and not holds(words, own):
                        own = exact_runs(data[a:b], words)
                    n_words.append(len(words))
                    all_runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
                    collapsed.append(b" ".join(kept_words(words, own) if own else words))
            result = pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(all_runs, pa.list_(RUN)), pa.array(collapsed, pa.binary()).cast(pa.string())], ["n_words", "runs", "collapsed"])
            yield pa.RecordBatch.from_arrays([*batch.columns, result], [*batch.schema.names, "result"])

    return run


def runs_column(docs: DataFrame) -> str:
    return free("__runs", docs.columns)


def periodic_runs(spark: SparkSession, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with a struct `__runs`: n_words, runs (start, length, period, by start and period), collapsed (words kept, joined by one space).

    Words are maximal runs of bytes other than space and \\t \\n \\v \\f \\r, case kept. A run is a stretch of words of least
    period p and at least max(6, 4 p) words that cannot be made longer. Each row is worked on by itself, so repeated rows
    and ids of any kind give rows of their own; null, empty and wordless texts have no runs and an empty `collapsed`;
    an empty table gives none; columns of any name may stand beside the text. Long texts take their pairs in parts.
    """
    result = runs_column(docs)
    flat = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    own = f"c{[c.lower() for c in docs.columns].index(text_col.lower())}"
    kind = "struct<n_words: bigint, runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>"
    return flat.mapInArrow(_found(own), with_field(flat.schema, "result", kind)).toDF(*docs.columns, result)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The texts of every tenth document by the checksum of its id, from some word on a repetition of the words there; null ids count as empty."""
    h = F.crc32(F.coalesce(col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.regexp_extract_all(F.coalesce(col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def planted(w):
        n, g = F.size(w), F.floor(h / 10)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))), " ")

    some = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, planted(w)).otherwise("")), 1)
    return docs.withColumn("text", F.when(F.pmod(h, F.lit(10)) == 0, some).otherwise(col("text")))
