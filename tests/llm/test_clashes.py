"""Every operator on tables whose other columns bear the names that operators use, and on odd rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plotweld.llm import common, embedding_dedup, licenses, line_dedup, mixing, ngram_join, queries, secrets, sentencepieces, topk, toxicity, training_order

DATA = "/root/testdata/sf0.001"
NAMES = "__n __rest __k __take __skip __source __target __size __mix __text __score __o __dh __drops __lines o dh drops parts size taken source_size target k n g m c0 c1 f1 file row row_number a.b".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in NAMES)
LINE = "a line of words that is long enough to be compared with others"
ROWS = [(1, f"{LINE}\nown one"), (2, f"{LINE}\nown two"), (2, None), (3, ""), (None, f"{LINE} x"), (4, "idiot " * 8)]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s" if k % 2 else None, 0, *(f"{c}{k}" for c in NAMES)) for k, (i, t) in enumerate(ROWS)], SCHEMA)


def kept(df, docs):
    """The foreign columns of the result's rows are those of the input's."""
    assert df.columns[: len(docs.columns)] == docs.columns
    return all(r[c] == c + r[NAMES[0]][len(NAMES[0]) :] for r in df.collect() for c in NAMES)


def test_columns_stay(spark, docs):
    lines = line_dedup.line_dedup(spark, docs)
    assert kept(lines, docs) and lines.columns[-1] == line_dedup.lines_column(docs) == "__lines_"
    assert {r.text for r in lines.where("doc_id = 2").collect()} == {"own two", None}
    mixed = mixing.mix_sources(spark, docs)
    assert kept(mixed, docs) and mixed.columns[-1] == "__mix_"
    out = mixing.materialise_mix(mixed)
    assert kept(out, docs) and out.columns == docs.columns
    whole = mixing.materialise_mix(mixed, whole=True)
    assert kept(whole, docs) and {r.text for r in whole.collect()} <= {t for _, t in ROWS}
    scored = toxicity.score_toxicity(spark, docs, ({"idiot": 3.0}, __import__("numpy").array([3.0, 3.0, 0.0, 0.0, -1.0])))
    assert kept(scored, docs) and scored.columns[-1] == "__score_"
    assert sorted(r.doc_id for r in scored.where("__score_ > 0.5").collect()) == [4]


def test_other_operators_run(spark, docs):
    n = len(ROWS)
    assert ngram_join.ngram_jaccard_join(spark, docs).count() == n and secrets.secret_scan(spark, docs).count() == n and licenses.license_scan(spark, docs).count() == n
    assert sentencepieces.sample_encode(spark, docs, f"{queries.TOKENIZERS}/{sentencepieces.MODEL}").count() == n
    assert training_order.training_records(spark, docs).count() == n
    vectors = spark.createDataFrame([(i, [1.0, float(i)], 1, *NAMES) for i in range(60)], "vec_id bigint, embedding array<double>, label int, " + ", ".join(f"`{c}` string" for c in NAMES))
    assert embedding_dedup.embedding_near_dedup(spark, vectors).count() == 60 and topk.exact_top_k(spark, vectors).count() == 10


def test_stages_keep_columns(spark, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.Scratch(spark, "clash").save(stage(spark, docs, DATA))
        assert kept(out, docs) and out.columns == docs.columns, name


def test_string_ids(spark, docs):
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard_join(spark, named).collect()}
    assert got["d2"] == "d1" or got["d2"] == "d2"
    assert {r.doc_id for r in licenses.license_scan(spark, named).collect()} == {None, "d1", "d2", "d3", "d4"}
    rows = sentencepieces.sample_encode(spark, named, f"{queries.TOKENIZERS}/{sentencepieces.MODEL}").collect()
    assert len(rows) == len(ROWS) and all(r.lossless for r in rows)


def test_near_copy_stage_tells_rows_apart(spark):
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(3, a), (5, a), (5, b), (7, b + " end"), (9, b), (9, b), (None, a), (11, None), (11, None), (12, ""), (12, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = corpus_pipeline.drop_near_copies(spark, docs, DATA).collect()
    assert sorted((r.doc_id, r.text or "") for r in left) == [(3, a), (5, b), (11, ""), (11, ""), (12, ""), (12, "")]


def test_sets_that_share_a_fingerprint(spark):
    """With a fingerprint of a few values only, unlike sets stay apart."""
    def weak(s):
        from plotweld.llm.ngram_join import _prints

        f1, f2 = _prints(s)
        return f1 % 3, f2

    rows = [(i, " ".join(f"w{i // 3}x{k}" for k in range(20 + i // 3))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {(i, i // 3 * 3, 2) for i, _ in rows}
    assert {(r.doc_id, r.component_id, r.n_links) for r in ngram_join.ngram_jaccard_join(spark, docs, fingerprint=weak).collect()} == want


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_lines_of_all_lengths_by_hand(spark):
    import random

    rng = random.Random(4)
    lines = []
    for n in [*range(1, 40), 63, 64, 65, 99, 100, 101, 400, 401]:
        base = "".join(rng.choice("abcdeé𝄞 ") for _ in range(n - 1)) + "x"
        for _ in range(5):
            at, kind = rng.randrange(n), rng.randrange(4)
            lines.append((base, base[:at] + rng.choice("pqé𝄞") + base[at + 1 :], base[:at] + base[at + 1 :], base[:at] + rng.choice("pq") + base[at:])[kind])
    lines = [x for x in lines if x.strip()]
    rng.shuffle(lines)
    docs = [(i, "\n".join(lines[i::7])) for i in range(7)]
    order = [(i, pos, x) for i, t in docs for pos, x in enumerate(t.split("\n"))]
    want = {(i, pos) for k, (i, pos, x) in enumerate(order) if any(one_edit(x, y) for _, _, y in order[:k])}
    got = line_dedup.dropped_lines(spark, spark.createDataFrame(docs, "doc_id bigint, text string"), min_chars=1).collect()
    assert {(r.o, pos) for r in got for pos in r.drops} == want


def test_very_long_lines(spark):
    import time

    base = "".join(chr(97 + (i * i * 7 + i // 11) % 26) for i in range(900_000))
    rows = [(1, base), (2, base[:450_000] + "#" + base[450_001:]), (3, base[:-3] + base[-2:]), (4, base[:500] + "!!" + base[502:])]
    began = time.time()
    got = line_dedup.dropped_lines(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), min_chars=1).collect()
    assert {r.o for r in got} == {2, 3} and time.time() - began < 120
