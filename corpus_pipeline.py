"""From raw documents to token ids: reject toxic texts, drop copies and near copies, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return
the columns of documents. A stage sees everything that the one before it kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessile.llm import exact_dedup, jaccard, mixing, pieces, toxicity
from sessile.llm.common import stored, table, unused, work_dir


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold; labels come from the labels table.

    Null and empty texts have the score of a text that is like no example. Rows of equal
    text share their fate; without labels of both classes the share of label 1 decides
    for all. An empty table stays empty.
    """
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score, evidence = unused(docs, "_score"), unused(docs, "_evidence")
    return toxicity.scored(docs, index, score, evidence).filter(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the document of the smallest id (all rows of that id that are equal).

    Null ids come last; where all ids of a group are null, all its rows stay. Null texts count as empty.
    """
    decided = exact_dedup.dedup(docs)
    # The digest tells apart rows that share an id but not a text.
    kid, digest, own = (unused(docs, c) for c in ("_id", "_digest", "_own"))
    kept = decided.filter("kept").select(F.col("doc_id").alias(kid), F.unhex("text_sha256").alias(digest)).distinct()
    marked = docs.withColumn(own, F.unhex(F.sha2(exact_dedup.normalised(F.coalesce("text", F.lit(""))), 256)))
    return marked.join(kept, F.col("doc_id").eqNullSafe(F.col(kid)) & (F.col(own) == F.col(digest)), "left_semi").select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts: that of the smallest id.

    Texts without words are linked with nothing and stay. Rows of one id with equal sets stay or go together.
    """
    decided = jaccard.decided(docs)
    # The digest tells apart rows that share an id but not a set of shingles.
    gone, digest, own = (unused(docs, c) for c in ("_id", "_digest", "_own"))
    dropped = stored(decided.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(gone), F.col("digest").alias(digest)).distinct(), "near-copies")
    return jaccard.digested(docs, own).join(dropped, F.col("doc_id").eqNullSafe(F.col(gone)) & (F.col(own) == F.col(digest)), "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Texts without words, null ones included, have size 0 and are taken by the hash of
    their id like others. A null source is a source, the last one. Rows of one id are
    taken together; an empty table stays empty.
    """
    return mixing.mixed_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with their digests: one row for each row, a null or empty text has the end id alone."""
    out = pieces.encode(docs)
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"))


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("ngram_join", without_near_copies),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

#: SQL cannot say the first stage; tests/llm compare each stage with a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{work_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
