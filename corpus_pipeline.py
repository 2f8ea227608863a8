"""The corpus pipeline: toxicity, line dedup, n-gram Jaccard join, mixing, SentencePiece pieces.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last
return the columns of `docs`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweld.llm import line_dedup, mixing, ngram_join, sentencepieces, toxicity
from plotweld.llm.common import Scratch, col, table
from plotweld.llm.queries import TOKENIZERS

REJECT = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at REJECT or more go; the score is learnt from all documents that have labels.

    Null and empty texts have no hits and stay; repeated rows are scored each for itself; a score of just REJECT goes.
    """
    known = toxicity.labelled_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(spark, docs, toxicity.learn(spark, known))
    return scored.where(col(toxicity.score_column(docs)) < REJECT).select([col(c) for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of any length that repeat or all but repeat an earlier line go; a document left without words goes.

    Null texts stay null, empty ones stay empty; rows equal in id and text count as one document and keep the same
    lines; of equal lines the one of the smallest id, then line number, stays.
    """
    out = line_dedup.line_dedup(spark, docs, min_chars=1)
    counts = col(line_dedup.lines_column(docs))
    emptied = (counts["n_dropped"] > 0) & (F.length(F.trim("text")) == 0)
    return out.where(~F.coalesce(emptied, F.lit(False))).select([col(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: that of the smallest doc_id (null ids last).

    Rows are told apart by a number of their own, so equal rows are copies of each other, and an unlike text under
    the same id stays. Null, empty and wordless texts are near copies of nothing and all stay.
    """
    # Own names for the columns of `docs`: none clashes with those added here.
    own = dict(zip(docs.columns, (f"c{k}" for k in range(len(docs.columns))), strict=True))
    rows = Scratch(spark, "near").save(docs.toDF(*own.values()).withColumn("row", F.monotonically_increasing_id()))
    found = ngram_join.ngram_jaccard_join(spark, rows, id_col="row", text_col=own["text"]).where("component_id <> doc_id")
    copies = found.select(F.col("doc_id").alias("copy"), F.col("component_id").alias("group"))
    copies = copies.unionByName(copies.select(F.col("group").alias("copy"), "group").distinct())
    ids = rows.select("row", F.col(own["doc_id"]).alias("id"))
    stays = copies.join(ids, F.col("copy") == F.col("row")).groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "copy")).alias("first"))
    gone = copies.join(stays, "group").where("copy <> first.copy").select("copy")
    return rows.join(gone, F.col("row") == F.col("copy"), "left_anti").select(*(F.col(own[c]).alias(c) for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as the mix of sources takes them.

    Null and wordless texts have no words to take and go; null is a source of its own; repeated rows are taken each.
    """
    return mixing.materialise_mix(mixing.mix_sources(spark, docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of every text; null and empty texts have none, repeated rows have the same."""
    return sentencepieces.sample_encode(spark, docs, f"{TOKENIZERS}/{sentencepieces.MODEL}")


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("ngram_join", drop_near_copies), ("mixing", mix), ("sentencepiece", encode)]

#: Neither the learnt score nor sampled pieces can be written in SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over `documents`, each stage's rows written and read again; a table goes once the next one is written."""
    box = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), []
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = box.save(docs)
            box.drop(*before)
            before = [docs]
    return docs
