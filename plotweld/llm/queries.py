"""The registered queries of the operators, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, filter_audit, licenses, line_dedup, mixing, ngram_join, periodic, repeats, secrets, sentencepieces, topk, toxicity, training_order
from .common import table

TOKENIZERS = "/opt/tokenizers"


def op1_sentencepiece_sampling(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sentencepieces.sample_encode(spark, docs, f"{tokenizers}/{sentencepieces.MODEL}")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_near_dedup(spark, table(spark, sf_dir, "embeddings"))


def op3_training_order(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    encoder = training_order.RankEncoder(spark, f"{tokenizers}/{training_order.VOCABULARY}")
    return training_order.written_records(spark, training_order.training_records(spark, table(spark, sf_dir, "documents"), encoder=encoder, pack=True))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(spark, docs).select("doc_id", "__mix.size", "__mix.source_size", "__mix.target", "__mix.taken")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(spark, toxicity.labelled_texts(docs, table(spark, sf_dir, "labels")))
    scored = toxicity.score_toxicity(spark, docs, model)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.7).cast("int").alias("predicted"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(spark, table(spark, sf_dir, "documents"))
    label = F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string"), m["coverage"].cast("string")))
    return found.select("doc_id", F.size("matches").cast("bigint").alias("n_matches"), F.array_join(label, ",").alias("matches"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_scan(spark, table(spark, sf_dir, "documents"))
    spans = secrets.joined(F.concat("base", "added"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), spans.alias("spans"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(spark, table(spark, sf_dir, "embeddings"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=1)
    return out.select("doc_id", "__lines.n_lines", "__lines.n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(spark, table(spark, sf_dir, "documents"))


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("__repeats.spans", F.lit(0).cast("bigint"), lambda a, s: a + s["last"] - s["first"])
    return out.select("doc_id", "__repeats.n_bytes", removed.alias("n_removed"), F.size("__repeats.spans").cast("bigint").alias("n_spans"), F.sha2("__repeats.kept", 256).alias("kept_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.periodic_runs(spark, periodic.with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    runs = F.col("__runs.runs")
    order = F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    lines = F.transform(runs, lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    joined = F.when(F.size(runs) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    out = out.select("doc_id", F.size(runs).cast("bigint").alias("n_runs"), F.array_min(order).alias("longest"), F.sha2(joined, 256).alias("runs_sha256"), F.sha2("__runs.collapsed", 256).alias("collapsed_sha256"))
    milli = F.floor(1000 * F.col("longest.length") / F.col("longest.period")).cast("bigint")
    return out.select("doc_id", "n_runs", "longest.start", "longest.length", "longest.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    named = (
        op1_sentencepiece_sampling, op2_embedding_near_dedup, op3_training_order, op4_mixing, op5_toxicity, op6_license_scan,
        op7_secret_scan, op8_exact_top_k, op9_line_dedup, op10_ngram_jaccard_join, op11_suffix_array_dedup, op12_periodic_runs,
        op13_filter_audit,
    )
    return {f.__name__: f for f in named}


ORACLE = {
    "op2_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), n AS (SELECT a, count(*) AS n FROM links GROUP BY a), c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT v.vec_id, COALESCE(n.n, 0) AS n_links, LEAST(v.vec_id, COALESCE(c.c, v.vec_id)) AS component_id,
       v.vec_id = LEAST(v.vec_id, COALESCE(c.c, v.vec_id)) AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN c ON c.a = v.vec_id
""",
    "op4_mixing": r"""
WITH d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS size, [3, 1, 2][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source
), o AS (
  SELECT *, count(*) OVER r AS rn, COALESCE(sum(2 * size) OVER r, 0) AS capped, sum(w) OVER () - COALESCE(sum(w) OVER r, 0) AS rest, 1.5::DOUBLE * sum(size) OVER () AS budget
  FROM s WINDOW r AS (ORDER BY 2.0 * size / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT arg_min((budget - capped) / rest, rn) FILTER (WHERE w * ((budget - capped) / rest) <= 2.0 * size) AS level FROM o
), t AS (
  SELECT source, size, CASE WHEN level IS NULL OR w * level > 2 * size THEN 2.0 * size ELSE w * level END::DOUBLE AS target FROM s, l
)
SELECT d.doc_id, d.size, t.size AS source_size, t.target,
  CASE WHEN t.size > 0 THEN LEAST(CAST(floor(t.target * d.size / t.size + CAST('0x' || substr(md5('7:' || COALESCE(CAST(d.doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE) AS BIGINT), 2 * d.size) ELSE 0 END AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
""",
    "op8_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op9_line_dedup": r"""
WITH l AS (
  SELECT doc_id, text, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL
), f AS (
  SELECT line, min({'d': doc_id, 'p': pos}) AS first FROM l WHERE length(line) >= 20 OR regexp_matches(line, '\S') GROUP BY line
), h AS (
  SELECT line, first, unnest(list_distinct([hash(length(line) // 4 , substr(line, 1, 4)), hash(length(line) // 4, 's', right(line, 4)), hash((length(line) - 1) // 4, substr(line, 1, 4)), hash((length(line) - 1) // 4, 's', right(line, 4)), CASE WHEN length(line) <= 8 THEN hash('short') END])) AS k FROM f
), gone AS (
  SELECT DISTINCT a.line FROM h a JOIN h b ON a.k = b.k AND b.first < a.first AND abs(length(a.line) - length(b.line)) <= 1 WHERE levenshtein(a.line, b.line) <= 4 AND CASE length(a.line) - length(b.line)
    WHEN 0 THEN len(list_filter(range(1, length(a.line) + 1), lambda i: substr(a.line, i, 1) <> substr(b.line, i, 1))) <= 1
    WHEN 1 THEN list_bool_or(list_transform(range(length(a.line)), lambda i: concat(substr(a.line, 1, i), substr(a.line, i + 2)) = b.line))
    ELSE list_bool_or(list_transform(range(length(b.line)), lambda i: concat(substr(b.line, 1, i), substr(b.line, i + 2)) = a.line)) END
), kept AS (
  SELECT l.*, f.line IS NULL OR (g.line IS NULL AND f.first = {'d': l.doc_id, 'p': l.pos}) AS keep
  FROM l LEFT JOIN f ON f.line = l.line LEFT JOIN gone g ON g.line = l.line
), d AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT keep) AS n_dropped, sha256(COALESCE(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keep), '')) AS text_sha256 FROM kept GROUP BY doc_id
)
SELECT doc_id, n_lines, n_dropped, text_sha256 FROM d
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
""",
    "op10_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM w
), n AS (SELECT doc_id, COALESCE(len(sh), 0) AS n FROM s), e AS (SELECT doc_id, unnest(sh) AS x FROM s), links AS (
  SELECT a, b FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), k AS (SELECT a, count(*) AS k FROM links GROUP BY a), c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, LEAST(n.doc_id, COALESCE(c.c, n.doc_id)) AS component_id, COALESCE(k.k, 0) AS n_links FROM n LEFT JOIN k ON k.a = n.doc_id LEFT JOIN c ON c.a = n.doc_id
""",
    "op13_filter_audit": r"""
WITH lab AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1
), d AS (
  SELECT doc_id, COALESCE(text, '') AS t, COALESCE(source, '') AS part, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), m AS (
  SELECT part, COALESCE(good, 0) AS good, COALESCE(toxic, 0) AS toxic, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'),
    d.doc_id > min(d.doc_id) OVER (PARTITION BY t)] AS f FROM d LEFT JOIN lab USING (doc_id)
), c AS (
  SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2
), l AS (SELECT unnest([1, 2, 3, 4, 5]) AS x), o AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT part, o, i AS step, n, good, toxic, f[o[i]] AS own, COALESCE(list_bool_or([f[k] for k in o[1:i - 1]]), false) AS earlier, len(list_filter(f, lambda b: b)) AS fails FROM c, o, (SELECT unnest([1, 2, 3, 4, 5]) AS i) st
), r AS (
  SELECT part, o, step, sum(n) FILTER (WHERE NOT own AND NOT earlier) AS kept, sum(n) FILTER (WHERE own AND NOT earlier) AS removed, sum(n) FILTER (WHERE own AND earlier) AS redundant, sum(n) FILTER (WHERE own AND fails = 1) AS unique_fails,
    sum(good) FILTER (WHERE own AND NOT earlier) AS good_lost, sum(toxic) FILTER (WHERE own AND NOT earlier) AS toxic_lost FROM s GROUP BY 1, 2, 3
)
SELECT part, array_to_string([chr(64 + x) for x in o], '') AS filter_order, step::INTEGER AS step, COALESCE(kept, 0)::BIGINT AS kept, COALESCE(removed, 0)::BIGINT AS removed, COALESCE(redundant, 0)::BIGINT AS redundant,
  COALESCE(unique_fails, 0)::BIGINT AS unique_fails, COALESCE(good_lost, 0)::BIGINT AS good_lost, COALESCE(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(COALESCE(removed, 0)) OVER (PARTITION BY part, o[step]))::BIGINT AS shapley FROM r
""",
}
