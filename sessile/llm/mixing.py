"""Mixing sources to target weights by nested hash thresholds.

Each document has a fixed 60-bit hash. A source whose target is r whole passes
and a rest takes every document r times, and once more those whose hash lies
below a threshold. The threshold comes from histograms: words by source and hash
bucket, then again within the one bucket in which the rest runs out, until that
bucket holds a single hash. Documents are filtered by it, never sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessile.llm.common import WORD, hash60, joined_small, stored, table, text_or_empty, unused

#: Weights of the sources in order, repeating, and the most passes over a source.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_PASSES = 3
#: Bits of the hash, and bits that one histogram level resolves.
BITS, STEP = 60, 10


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """Per source: source, source_size, target.

    Sharing the excess again and again ends where every source below its cap has
    level * weight, so one ordered pass over the sources (one row each) finds the
    level: capped are those with the smallest cap / weight.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    up_to = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (sources.withColumn("weight", w).withColumn("cap", F.lit(float(max_passes)) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(up_to), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(up_to), F.lit(0.0)))
        .withColumn("level", (F.sum("source_size").over(everything) - F.col("capped_before")) / F.col("weight_left")))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    # The first source in order that is not capped gives the level; later ones repeat or exceed it.
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything).getField("level")
    return ranked.withColumn("shared", F.coalesce(first, level)).select("source", "source_size", F.least("cap", F.col("shared") * F.col("weight")).alias("target"))


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source: passes (whole ones), threshold (documents with a smaller hash are taken once more)."""
    goal = goals.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    n = goal.count()
    # path: the bits fixed so far; below: words of smaller hashes outside the boundary bucket.
    state = goal.select("source", "target", "source_size", "passes", "rest", F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("below"))
    for level in range(1, BITS // STEP + 1):
        shift = BITS - STEP * level
        inside = joined_small(sized, state.select(F.col("source").alias("s"), "path"), [F.expr("source <=> s"), F.expr(f"shiftright(hash, {shift + STEP}) = path")], rows=n) if level > 1 else sized
        buckets = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        at = Window.partitionBy("source").orderBy("bucket")
        ran = (joined_small(buckets, state.select(F.col("source").alias("s"), "rest", "below"), [F.expr("source <=> s")], rows=n).drop("s")
            .withColumn("upto", F.col("below") + F.sum("words").over(at)).withColumn("before", F.col("upto") - F.col("words")))
        # The boundary bucket is the first that the rest does not fill.
        edge = ran.filter(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min(F.struct("bucket", "before", "words", "low", "high")).alias("e"))
        state = stored(
            joined_small(state.select(F.col("source").alias("s"), "target", "source_size", "passes", "rest", "path", "below"), edge, [F.expr("source <=> s")], "left", rows=n)
            .select(F.col("s").alias("source"), "target", "source_size", "passes", "rest", F.coalesce("e.bucket", F.shiftleft("path", STEP)).alias("path"), F.coalesce("e.before", "below").alias("below"), F.col("e.words").alias("words"), F.col("e.low").alias("low"), F.col("e.high").alias("high")),
            "mix-state",
        )
        if not state.filter("low <> high").limit(1).count():
            break
    # A single hash is left: it is taken if that comes nearer to the target. With no boundary all rows are below.
    nearer = F.col("below") + F.col("words") - F.col("rest") <= F.col("rest") - F.col("below")
    may_repeat = (F.col("passes") < MAX_PASSES) & (F.col("rest") > 0)
    threshold = F.when(~may_repeat, F.lit(-1)).when(F.col("low").isNull(), F.lit(1 << BITS)).when(nearer, F.col("high") + 1).otherwise(F.col("low"))
    return state.select("source", "source_size", "target", "passes", threshold.cast("long").alias("threshold"))


def sized_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words(text_or_empty()).alias("size"), hash60(F.col("doc_id")).alias("hash"))


def mix(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken.

    A null text has size 0, a null source is a source. Rows of equal id share a
    hash and so are taken alike. An empty table gives no rows. Other columns of
    the documents are ignored.
    """
    sized = stored(sized_rows(docs), "mix-sizes")
    goals = stored(targets(sized), "mix-targets")
    limits = thresholds(sized, goals)
    joined = joined_small(sized, limits.withColumnRenamed("source", "s"), [F.expr("source <=> s")])
    copies = F.col("passes") + (F.col("hash") < F.col("threshold")).cast("long")
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), "source", copies.alias("copies"))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns it came with."""
    sized = stored(sized_rows(docs).select("source", "size", "hash"), "mix-sizes")
    limits = thresholds(sized, stored(targets(sized), "mix-targets"))
    own, passes, threshold, copy = (unused(docs, f"_{c}") for c in ("s", "passes", "threshold", "copy"))
    limits = limits.select(F.col("source").alias(own), F.col("passes").alias(passes), F.col("threshold").alias(threshold))
    taken = joined_small(docs, limits, [F.col("source").eqNullSafe(F.col(own))])
    copies = (F.col(passes) + (hash60(F.col("doc_id")) < F.col(threshold)).cast("long")).cast("int")
    return taken.withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies))).select(*docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: Independent of the operator: caps are found round by round, and documents are sorted.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '~')), 1, 15))::BIGINT AS hash
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
rounds AS (
  SELECT source, source_size, weight, false AS capped, 0 AS i FROM w
  UNION ALL
  SELECT source, source_size, weight, capped OR 3.0 * source_size < weight * (tot - used) / free, i + 1
  FROM (SELECT *, sum(source_size) OVER () AS tot,
               coalesce(sum(3.0 * source_size) FILTER (WHERE capped) OVER (), 0)::DOUBLE AS used,
               sum(weight) FILTER (WHERE NOT capped) OVER () AS free FROM rounds) WHERE i < 40),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN 3.0 * source_size
         ELSE (tot - used) / free * weight END::DOUBLE AS target
  FROM (SELECT *, sum(source_size) OVER () AS tot,
               coalesce(sum(3.0 * source_size) FILTER (WHERE capped) OVER (), 0)::DOUBLE AS used,
               sum(weight) FILTER (WHERE NOT capped) OVER () AS free FROM rounds WHERE i = 40)),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS passes FROM t),
h AS (SELECT source, hash, sum(size)::BIGINT AS words FROM d GROUP BY source, hash),
c AS (
  SELECT h.source, hash, words, passes, target - passes * source_size AS rest,
         sum(words) OVER (PARTITION BY h.source ORDER BY hash) - words AS before
  FROM h JOIN r ON h.source IS NOT DISTINCT FROM r.source),
k AS (
  SELECT source, hash, passes + CASE WHEN passes < 3 AND rest > 0 AND (before + words <= rest
         OR (before <= rest AND before + words - rest <= rest - before)) THEN 1 ELSE 0 END AS copies FROM c)
SELECT d.doc_id, d.size, r.source_size, r.target, (d.size * k.copies)::BIGINT AS taken
FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.hash = k.hash
JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
