"""Methods against direct versions: the randomness battery, false discovery, the piece lattice, SQL of the joins."""

import collections
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plotweld.llm import queries, secrets, sentencepieces

DATA = "/root/testdata/sf0.001"
MODEL = f"{queries.TOKENIZERS}/{sentencepieces.MODEL}"


def tail(z):
    return math.erfc(z / math.sqrt(2)) / 2


def battery(token):
    """The least of three p-values, times three, by the textbook formulas."""
    alphabet = next(a for _, a in secrets.ALPHABETS if set(token) <= set(a))
    n, k = len(token), len(alphabet)
    counts = collections.Counter(token)
    chi = (sum((counts[c] - n / k) ** 2 for c in alphabet) / (n / k) - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    bits = [int(alphabet.index(c) >= k // 2) for c in token]
    ones = sum(bits)
    runs = 1 + sum(a != b for a, b in zip(bits[:-1], bits[1:], strict=True))
    m = 2 * ones * (n - ones)
    z_runs = 9.0 if m <= n else abs(runs - m / n - 1) / math.sqrt(m * (m - n) / (n * n * (n - 1)))
    v = np.array([alphabet.index(c) + 1.0 for c in token])
    spread = ((v - v.mean()) ** 2).sum()
    serial = ((v[:-1] - v.mean()) * (v[1:] - v.mean())).sum() / spread if spread else 1.0
    return min(1.0, 3 * min(tail(chi), 2 * tail(z_runs), 2 * tail(abs((serial + 1 / n) * math.sqrt(n)))))


def test_battery(spark):
    rng = random.Random(5)
    tokens = ["".join(rng.choice(a) for _ in range(rng.randint(16, 80))) for _, a in secrets.ALPHABETS for _ in range(6)]
    tokens += ["a" * 20, "ab" * 15, "abcdefghijklmnopqrstuvwxyz", "0123456789" * 4, "internationalization"]
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets.battery(F.col("t")).alias("b")).collect()
    for r in rows:
        assert abs(r.b.p_random - battery(r.t)) < 1e-5, r.t


def test_false_discovery_rate():
    rng = np.random.default_rng(3)
    for _ in range(50):
        bins = rng.integers(0, 60, 400)
        p = np.sort(10.0 ** (-bins / 10))
        good = np.flatnonzero(p <= 0.05 * np.arange(1, len(p) + 1) / len(p))
        least = secrets.least_bins({0: dict(collections.Counter(bins.tolist()))}, 0.05)[0]
        assert int((bins >= least).sum()) == (good[-1] + 1 if len(good) else 0)


def test_lattice_over_all_segmentations():
    p = sentencepieces.load_pieces(MODEL, 1.0)
    known = {t: i for i, t in enumerate(p.text) if t}
    word, n = b"thereis", 40_000
    ways = {}

    def walk(at, ids):
        if at == len(word):
            ways[tuple(ids)] = math.exp(sum(p.log[i] for i in ids))
        for end in range(at + 1, len(word) + 1):
            i = known.get(word[at:end])
            if i is not None and (end - at > 1 or i not in set(p.byte_ids.tolist())):
                walk(end, [*ids, i])

    walk(0, [])
    ids, counts = sentencepieces.sample_rows(p, np.tile(np.frombuffer(word, np.uint8), n), np.arange(0, len(word) * n + 1, len(word)), np.arange(n).astype(np.uint64), 5)
    seen = collections.Counter(tuple(int(x) for x in part) for part in np.split(ids, np.cumsum(counts)[:-1]))
    total = sum(ways.values())
    assert set(seen) <= set(ways) and len(ways) > 10
    for way, mass in ways.items():
        assert abs(seen[way] / n - mass / total) < 5 * math.sqrt(mass / total / n) + 1e-4


def test_text_without_spaces(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(30_000))
    row = sentencepieces.sample_encode(spark, spark.createDataFrame([(1, text)], "doc_id bigint, text string"), MODEL).first()
    assert row.lossless and row.n_pieces == len(row.ids)


@pytest.mark.parametrize("name", ["op10_ngram_jaccard_join", "op4_mixing", "op9_line_dedup"])
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    df = queries.queries()[name](spark, DATA)
    want = c.execute(queries.ORACLE[name])
    cols = [d[0] for d in want.description]
    assert cols == df.columns
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, want.fetchall()))
