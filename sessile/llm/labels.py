"""Bounded samples of labelled rows, shared by the two classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessile.llm.common import fold, hash60


def sample_of_labels(labels: DataFrame, label: str, folds: int, held_out: int, limit: int) -> DataFrame:
    """(doc_id, y): at most so many labelled ids outside the held-out fold, those with the least hashes.

    An id that is labelled more than once counts as 1 if its mean is at least one half.
    """
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    each = rows.groupBy("doc_id").agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("y"))
    return each.orderBy(hash60(F.col("doc_id")), "doc_id").limit(limit)


def labelled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, y, text) of the sampled ids that have documents; a sample is bounded, so it is broadcast.

    Null texts count as empty. Of an id with several texts the least one stands, so reruns agree.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
