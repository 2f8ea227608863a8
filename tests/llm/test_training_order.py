import numpy as np
import pytest

from plotweld.llm import queries, training_order

VOCABULARY = f"{queries.TOKENIZERS}/{training_order.VOCABULARY}"
TEXTS = ["", "one two", None, "word " * 3000, "x" * 40_000, "Ümlaut ▁ \r\n x" * 40, "one two", "<|endoftext|>"]


def stream(folder, n, encoder):
    got = list(training_order.read_from(folder, 0, 64, 50))
    assert [s for s, _ in got] == list(range(n))
    seqs = [None] * n
    for (_, ids), k in zip(got, training_order.unfeistel(np.arange(n), n, 2024), strict=True):
        seqs[k] = ids
    ids = np.concatenate(seqs)
    return ids[ids != encoder.pad]


@pytest.mark.parametrize("from_files", [True, False])
def test_packed_stream_round_trip(spark, tmp_path, from_files):
    rows = [(f"d{i}" if i else None, t, "f", 1) for i, t in enumerate(TEXTS * 5)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, file string, _metadata int").repartition(3)
    if from_files:
        docs.write.parquet(str(tmp_path / "docs"))
        docs = spark.read.parquet(str(tmp_path / "docs"))
    assert training_order._plain_scan(docs) == from_files
    encoder, folder = training_order.RankEncoder(spark, VOCABULARY), (tmp_path / "shards").as_uri()
    records = training_order.training_records(spark, docs, stride=64, per_shard=50, encoder=encoder, pack=True)
    placed = training_order.written_records(spark, records, folder).collect()
    n = len(placed)
    assert sorted(r.slot for r in placed) == list(range(n)) == sorted(r.seq for r in placed)
    assert sorted(r.n_tokens for r in placed)[1:] == [64] * (n - 1)
    ids = stream(folder, n, encoder)
    texts = [encoder.encoding().decode(d[:-1].tolist()) for d in np.split(ids, np.flatnonzero(ids == encoder.end) + 1)[:-1]]
    assert sorted(texts) == sorted(t or "" for _, t, _, _ in rows)
    middle = n // 2
    assert [(s, i.tolist()) for s, i in training_order.read_from(folder, middle, 64, 50)] == [(s, i.tolist()) for s, i in list(training_order.read_from(folder, 0, 64, 50))[middle:]]


def test_order_does_not_depend_on_splits(spark, tmp_path):
    rows = [(i, f"text number {i} " * (i % 40)) for i in range(3000)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4, "doc_id").write.option("parquet.block.size", 20_000).parquet(str(tmp_path / "docs"))
    found = set()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1g", "8k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            records = training_order.training_records(spark, spark.read.parquet(str(tmp_path / "docs")), stride=64, per_shard=50, pack=True)
            found.add(tuple(sorted((r.slot, bytes(r.payload)) for r in records.select("slot", "payload").collect())))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(found) == 1
