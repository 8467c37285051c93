"""Exact duplicates by a persistent digest index.

The index is a Spark table, bucketed and sorted by the digest of the normalised
text. A new batch is first reduced to one row per digest (partial aggregation, so
thousands of copies cost one row a task), then anti-joined with the index, which
is read in its buckets and so is not shuffled, and the survivors are appended. A
table without an index of its own goes through a new one in batches by rising id,
so that of equal texts the smallest id stays; that index is dropped at the end.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from sessile.llm.common import SPACE, stored, table, text_or_empty

#: A group with over this share of a batch's rows is hot; there are fewer than 1,000 of them.
HOT_SHARE = 1 / 1000
#: Batches in which a whole table goes through a new index.
BATCHES = 4


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space."""
    return F.regexp_replace(text, SPACE, " ")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of the normalised text as 32 bytes; a null text counts as empty."""
    return docs.select("doc_id", F.unhex(F.sha2(normalised(text_or_empty()), 256)).alias("digest"))


class DigestIndex:
    """Digests seen so far, with the row that was kept for each: (digest, keep_id, batch)."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = 64) -> None:
        self.spark, self.name, self.buckets = spark, name, buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def _save(self, rows: DataFrame) -> None:
        # Dealt by bucket, not by digest: a bucket is in one task, however many tasks there are, so a batch has one file a bucket.
        dealt = rows.repartition(self.buckets, F.pmod(F.hash("digest"), F.lit(self.buckets)))
        dealt.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def append(self, digested: DataFrame, batch: int) -> DataFrame:
        """Add the digests that are new. Returns the batch's groups: digest, first_id, group_size.

        Of equal texts in one batch the smallest doc_id stays (null ids last); texts
        that an earlier batch has keep the earlier row.
        """
        groups = stored(digested.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("group_size")), "digest-groups")
        if not self.exists():
            # An empty table by Spark alone: a list from Python would start a second set of workers, which stay in the executors' memory.
            self._save(digested.select("digest", F.col("doc_id").alias("keep_id"), F.lit(batch).alias("batch")).limit(0))
        fresh = groups.hint("merge").join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        self._save(fresh.select("digest", F.col("first_id").alias("keep_id"), F.lit(batch).alias("batch")))
        return groups

    def resolve(self, digested: DataFrame, groups: DataFrame) -> DataFrame:
        """One row per document of the batch: doc_id, keep_id, group_size, kept, digest.

        Documents of hot groups meet a broadcast table, which HOT_SHARE bounds to
        fewer than 1,000 rows; all others meet the index in its buckets.
        """
        kept = groups.join(self.rows(), "digest").select("digest", "keep_id", "group_size", (F.col("keep_id").eqNullSafe(F.col("first_id"))).alias("own"))
        kept = stored(kept, "digest-kept")
        n = groups.agg(F.sum("group_size")).first()[0] or 0
        hot = kept.filter(F.col("group_size") > max(1, n * HOT_SHARE))
        cold = kept.filter(F.col("group_size") <= max(1, n * HOT_SHARE))
        marked = digested.join(F.broadcast(hot.select("digest", F.lit(True).alias("is_hot"))), "digest", "left")
        both = [
            digested.join(F.broadcast(hot), "digest"),
            marked.filter("is_hot IS NULL").drop("is_hot").join(cold, "digest"),
        ]
        # Rows that repeat the id of the row that stays are its equals: all of them stay.
        return both[0].unionByName(both[1]).select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("own")).alias("kept"), "digest")


def in_batches(digested: DataFrame, batches: int) -> list[DataFrame]:
    """The rows in batches of about one size by rising doc_id, null ids last; ids that are not numbers make one batch."""
    if batches < 2 or not isinstance(digested.schema["doc_id"].dataType, NumericType):
        return [digested]
    cuts = sorted(set(digested.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01)))
    # The number of cuts at or below the id; a null id is beyond all of them.
    at = F.coalesce(sum((F.col("doc_id") > c).cast("int") for c in cuts), F.lit(len(cuts))) if cuts else F.lit(0)
    return [digested.filter(at == k) for k in range(len(cuts) + 1)]


def dedup(docs: DataFrame, index: DigestIndex | None = None, batch: int = 0) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and empty texts equal each other. Rows of one doc_id
    with equal texts share their fate. An empty table gives no rows; extra columns
    are ignored. With an index the documents are its next batch; without one they go
    through a new index in BATCHES batches.
    """
    digested = stored(digests(docs), "digests")
    if index is not None:
        out = index.resolve(digested, index.append(digested, batch))
    else:
        index = DigestIndex(docs.sparkSession, f"digest_index_{uuid.uuid4().hex}")
        try:
            groups = reduce(DataFrame.unionByName, [index.append(part, k) for k, part in enumerate(in_batches(digested, BATCHES))])
            out = index.resolve(digested, groups.groupBy("digest").agg(F.min("first_id").alias("first_id"), F.sum("group_size").alias("group_size")))
        finally:
            index.drop()
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM d JOIN g USING (text_sha256)
"""
