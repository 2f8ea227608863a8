import collections
import os
import random
import re
import zlib

import pytest

from plotweld.llm import queries
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables absent")


def auc(scores, labels):
    pos = [s for s, y in zip(scores, labels, strict=True) if y]
    neg = [s for s, y in zip(scores, labels, strict=True) if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@needs_tables
def test_toxicity_on_rows_never_learnt_from(spark, tmp_path):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = queries.op5_toxicity(spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    # Some 40 toxic rows are learnt from at this size; the figures of the larger one are below.
    held = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    toxic = [p for _, y, p in held if y]
    assert len(toxic) >= 5 and auc([s for s, _, _ in held], [y for _, y, _ in held]) >= 0.9
    assert sum(toxic) >= 0.8 * len(toxic) and not any(p for _, y, p in held if not y)
    # Neither the labels of held-out rows nor lang and source change a score.
    spark.read.parquet(f"{DATA}/documents.parquet").withColumns({"lang": F.lit("xx"), "source": F.lit("s")}).write.parquet(f"{tmp_path}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    spark.read.parquet(f"{DATA}/labels.parquet").withColumn("toxic", F.when(held_out, 1 - F.col("toxic")).otherwise(F.col("toxic"))).write.parquet(f"{tmp_path}/labels.parquet")
    again = {r.doc_id: r.score for r in queries.op5_toxicity(spark, str(tmp_path)).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in rows)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="driver tables absent")
def test_toxicity_figures_of_the_readme(spark):
    folder = "/root/testdata/sf0.1"
    known = spark.read.parquet(f"{folder}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    held = queries.op5_toxicity(spark, folder).where("held_out").join(known, "doc_id").collect()
    toxic = [r.predicted for r in held if r.toxic]
    assert auc([r.score for r in held], [r.toxic for r in held]) >= 0.97
    assert sum(toxic) >= 0.9 * len(toxic) and not any(r.predicted for r in held if not r.toxic)


@needs_tables
def test_toxicity_stage_rejects_toxic_rows_only(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    odd = docs.limit(1).withColumn("text", F.explode(F.array(F.lit(None).cast("string"), F.lit(""), F.lit(" \n")))).withColumn("doc_id", F.lit(-1).cast("long"))
    copies = docs.where("doc_id < 60").withColumn("doc_id", (F.col("doc_id") + 10**9).cast("long"))
    kept = corpus_pipeline.drop_toxic(spark, docs.unionByName(odd.select(docs.columns)).unionByName(copies), DATA)
    assert kept.columns == docs.columns
    got = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    before = {r.doc_id: r.text for r in docs.collect()}
    gone = {i for i, t in before.items() if (i, t) not in got}
    assert gone and all(labels.get(i, 1) == 1 for i in gone)
    toxic = {i for i, y in labels.items() if y == 1 and i in before}
    assert len(gone & toxic) >= 0.7 * len(toxic)
    # The same text has the same fate under any id; texts without words stay; nothing is altered or repeated.
    assert all(((i + 10**9, before[i]) in got) == (i not in gone) for i in before if i < 60)
    assert all(got[(-1, t)] == 1 for t in (None, "", " \n")) and all(n == 1 for n in got.values())


def filled(sizes, weights, total, most):
    """Water-filling by bisection on the level: source s gets min(most * size, level * weight)."""
    low, high = 0.0, total * 1e6
    for _ in range(300):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(most * s, level * w) for s, w in zip(sizes, weights, strict=True)) < total else (low, level)
    return [min(most * s, high * w) for s, w in zip(sizes, weights, strict=True)]


def test_mixing_stage_takes_the_targets(spark):
    import corpus_pipeline

    rng = random.Random(8)
    share = {"b": 0.34, "a": 0.1, None: 0.06, "d": 0.25, "c": 0.25}
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice((0, 1, 3, 20, 60)))), s) for i, s in enumerate(rng.choices(list(share), list(share.values()), k=600))] + [(600, None, "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = corpus_pipeline.mix(spark, df, DATA)
    assert out.columns == df.columns
    got = [(r.doc_id, r.text, r.source) for r in out.collect()]
    assert collections.Counter(got) == collections.Counter((r.doc_id, r.text, r.source) for r in corpus_pipeline.mix(spark, df.repartition(5), DATA).collect())
    order = sorted((s for s in share if s is not None)) + [None]
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    target = dict(zip(order, filled([size[s] for s in order], [(3, 1, 2)[k % 3] for k in range(len(order))], 1.5 * sum(size.values()), 2), strict=True))
    taken, of_row = collections.Counter(), collections.Counter()
    texts = {i: (t or "", s) for i, t, s in rows}
    for i, t, s in got:
        words = WORD.findall(t)
        assert s == texts[i][1] and words and " ".join(words) in " ".join(WORD.findall(texts[i][0]))
        taken[s] += len(words)
        of_row[i] += len(words)
    assert all(n <= 2 * len(WORD.findall(texts[i][0])) for i, n in of_row.items())
    assert all(abs(taken[s] - target[s]) <= 60 for s in order)
