"""A Merkle manifest of a table: leaves, roots, and a proof for each row.

Leaves are numbered within their language, and the number is written in digits. The
digit columns are grouped away one after the other inside blocks of FAN ** DIGITS
leaves: each grouping nests the children's structs in their parent, so a block becomes
one row that holds its whole tree. The blocks' own hashes are nodes of the next round,
until a language has one node left; the languages' roots go through the same rounds.
On the way back a block meets its path to the root as two rows of one grouping, and
nested transforms and an explode give each leaf its siblings; no level is joined.

A block has a bounded size whatever the language's, so a language with a third of all
rows is many blocks. All groupings of a round follow one shuffle by block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessile.llm.common import BROADCAST_ROWS, stored, table

#: Children of a node, and digits that one round groups away: blocks of 256 leaves.
FAN, DIGITS = 2, 8
#: Rows whose id's CRC-32 it divides have one added to n_chars in the test of tampering.
TAMPERED_EVERY = 7

_STEP = "struct<before:string,after:string>"


def sha(*texts: Column) -> Column:
    return F.sha2(F.concat(*texts), 256)


def field(c: Column) -> Column:
    """`-` for null, else the value's UTF-8 bytes: their count, a colon, the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """g (the language as a key that sorts nulls first), doc_id, leaf, tampered (null where the row is not tampered with)."""

    def leaf(n_chars: Column) -> Column:
        return sha(*[field(n_chars if c == "n_chars" else F.col(c)) for c in ("doc_id", "source", "lang", "n_chars", "text")])

    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED_EVERY == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("v"), "lang"), F.lit("")).alias("g"), "doc_id", leaf(F.col("n_chars")).alias("leaf"), F.when(hit, leaf(F.col("n_chars") + 1)).alias("tampered"),
    )


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add at (0, 1, ... by the order within g) and size (rows of g), without a window over rows.

    Rows are sorted by ranges, so a large g is many partitions; each partition's share
    of a g is then shifted by what lies before it.
    """
    placed = stored(
        rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "merkle-sorted"
    )
    each = placed.groupBy("g", "part").agg(F.min("place").alias("start"), F.count("*").alias("n"))
    before, whole = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("g")
    shifts = stored(each.select("g", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("start")).alias("shift"), F.sum("n").over(whole).alias("size")), "merkle-shifts")
    small = shifts.count() <= BROADCAST_ROWS  # a row for each partition and language
    return placed.join(F.broadcast(shifts) if small else shifts, ["g", "part"]).withColumn("at", F.col("place") + F.col("shift")).drop("part", "place", "shift")


def nodes_left(size: Column, level: int) -> Column:
    """Nodes that so many are reduced to after some levels."""
    return F.ceil(size / F.lit(FAN**level)).cast("long")


def block_trees(nodes: DataFrame) -> DataFrame:
    """(g, at, size, node) to one row a block, (g, at, size, tree), by grouping away one digit after the other.

    node has a field hash. A level is hashed as long as its g has several nodes left;
    above that the only child passes its hash on.
    """
    digit = [F.pmod(F.floor(F.col("at") / FAN**k), F.lit(FAN)).cast("int").alias(f"d{k}") for k in range(DIGITS)]
    rows = nodes.select("g", "size", F.floor(F.col("at") / FAN**DIGITS).cast("long").alias("block"), *digit, "node").repartition("g", "block")
    for k in range(DIGITS):
        rest = [f"d{j}" for j in range(k + 1, DIGITS)]
        kids = rows.groupBy("g", "size", "block", *rest).agg(F.sort_array(F.collect_list(F.struct(F.col(f"d{k}").alias("d"), F.col("node")))).alias("kids"))
        hashes = F.transform("kids", lambda x: x["node"]["hash"])
        parent = F.when(nodes_left(F.col("size"), k) > 1, F.sha2(F.array_join(hashes, ""), 256)).otherwise(hashes[0])
        rows = kids.select("g", "size", "block", *rest, F.struct(parent.alias("hash"), F.col("kids")).alias("node"))
    return rows.select("g", F.col("block").alias("at"), nodes_left(F.col("size"), DIGITS).alias("size"), F.col("size").alias("base"), F.col("node").alias("tree"))


def rounds(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Block trees of all rounds; in the last one each g has one row. most: the size of the largest g."""
    out = []
    while not out or most > 1:
        out.append(stored(block_trees(nodes), "merkle-blocks"))
        most = -(-most // FAN**DIGITS)
        nodes = out[-1].select("g", "at", "size", F.struct(F.col("tree.hash").alias("hash"), F.col("at").alias("at")).alias("node"))
    return out


def tips(tree: Column, base: Column, above: Column) -> Column:
    """All nodes at the bottom of a block's tree, each with the siblings on its way to the root, the nearest first."""

    def below(node: Column, level: int, path: Column) -> Column:
        if not level:
            return F.array(F.struct(node.alias("node"), path.alias("path")))
        kids = node["kids"]

        def one(kid: Column, i: Column) -> Column:
            hashes = F.transform(kids, lambda x: x["node"]["hash"])
            step = F.struct(F.array_join(F.slice(hashes, F.lit(1), i), "").alias("before"), F.array_join(F.slice(hashes, i + 2, F.lit(FAN)), "").alias("after"))
            steps = F.when(nodes_left(base, level - 1) > 1, F.array(step)).otherwise(F.array().cast(f"array<{_STEP}>"))
            return below(kid["node"], level - 1, F.concat(steps, path))

        return F.flatten(F.transform(kids, one))

    return below(tree, DIGITS, above)


def spread(trees: list[DataFrame], top: DataFrame) -> DataFrame:
    """From paths of whole trees, (g, at = 0, path, roots), to those of their leaves: g, node, path, roots."""
    paths = top
    for k, blocks in reversed(list(enumerate(trees))):
        both = blocks.select("g", "at", "tree", "base").unionByName(paths.select("g", "at", "path", "roots"), allowMissingColumns=True)
        met = both.groupBy("g", "at").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("tree", "base", "path", "roots")])
        tip = met.select("g", "roots", F.explode(tips(F.col("tree"), F.col("base"), F.col("path"))).alias("tip"))
        paths = tip.select("g", F.col("tip.node").alias("node"), F.col("tip.path").alias("path"), "roots")
        if k:
            paths = stored(paths.select("g", F.col("node.at").alias("at"), "path", "roots"), "merkle-paths")
    return paths


def largest(rows: DataFrame) -> int:
    return rows.agg(F.max("size")).first()[0] or 0


def manifest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, path (before, after: siblings of each level), folded_root, verified.

    A null is a value of its own in every field; rows without a language are the first
    group. Leaves of one id follow each other by their hash, so repeated rows have
    equal leaves and differ in their paths only; null ids come first, and are never
    tampered with. Texts are hashed whole. An empty table gives no rows, and so no
    root. Columns other than doc_id, source, lang, n_chars and text are ignored.
    """
    rows = numbered(stored(leaves(docs), "merkle-leaves"), ["doc_id", "leaf"])
    sizes = largest(rows)
    trees = rounds(rows.select("g", "at", "size", F.struct(F.col("leaf").alias("hash"), "doc_id", "tampered").alias("node")), sizes)
    roots = numbered(trees[-1].select(F.col("g").alias("lang"), F.lit("").alias("g"), F.col("tree.hash").alias("subroot")), ["lang"])
    above = rounds(roots.select("g", "at", "size", F.struct(F.col("subroot").alias("hash"), "lang").alias("node")), largest(roots))
    none = F.array().cast(f"array<{_STEP}>")
    whole = above[-1].select("g", "at", none.alias("path"), F.struct(F.col("tree.hash").alias("root")).alias("roots"))
    subroots = spread(above, whole).select(F.col("node.lang").alias("g"), F.lit(0).cast("long").alias("at"), "path", F.struct(F.col("node.hash").alias("subroot"), F.col("roots.root").alias("root")).alias("roots"))
    found = spread(trees, stored(subroots, "merkle-roots"))
    folded = F.aggregate("path", F.coalesce("node.tampered", "node.hash"), lambda h, s: sha(s["before"], h, s["after"]))
    out = found.select(F.col("node.doc_id").alias("doc_id"), F.col("node.hash").alias("leaf"), "roots.subroot", "roots.root", "path", folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    return manifest(table(spark, sf_dir, "documents")).select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", "verified")


#: CRC-32 of a text of digits, by the table of the reversed polynomial.
_CRC = """
  xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT),
    lambda crc, b: xor(crc >> 8, list_reduce([(xor(crc, b) & 255)::BIGINT] || [0, 0, 0, 0, 0, 0, 0, 0],
      lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))))
"""


def _leaf_sql(n_chars: str) -> str:
    def part(c: str) -> str:
        text = f"({c})::VARCHAR"
        return f"coalesce(octet_length(encode({text}))::VARCHAR || ':' || {text}, '-')"

    return f"sha256({' || '.join(part(n_chars if c == 'n_chars' else c) for c in ('doc_id', 'source', 'lang', 'n_chars', 'text'))})"


ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, {_leaf_sql("n_chars")} AS leaf,
    CASE WHEN {_CRC.format("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf_sql("n_chars + 1")} END AS tampered
  FROM documents),
leaves AS (
  SELECT *, coalesce('v' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n
  FROM d),
nodes AS (
  SELECT g, 0 AS level, pos, n, leaf AS h FROM leaves
  UNION ALL
  SELECT g, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY g, level, pos // 2, n),
subroots AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS level, pos, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY level, pos // 2, n),
walk AS (
  SELECT l.r, g, 0 AS step, 0 AS level, l.pos, l.n, false AS up, '' AS proof, coalesce(l.tampered, l.leaf) AS folded FROM leaves l
  UNION ALL
  SELECT r, w.g, step + 1, CASE WHEN w.n > 1 THEN w.level + 1 ELSE 0 END,
    CASE WHEN w.n > 1 THEN w.pos // 2 ELSE s.pos END, CASE WHEN w.n > 1 THEN (w.n + 1) // 2 ELSE s.n END, w.up OR w.n = 1,
    CASE WHEN w.n > 1 THEN w.proof || coalesce(x.h, y.h, '') ELSE w.proof END,
    CASE WHEN w.n = 1 THEN w.folded
      WHEN w.pos % 2 = 0 THEN sha256(w.folded || coalesce(x.h, y.h, '')) ELSE sha256(coalesce(x.h, y.h, '') || w.folded) END
  FROM walk w
  LEFT JOIN nodes x ON NOT w.up AND x.g = w.g AND x.level = w.level AND x.pos = xor(w.pos, 1)
  LEFT JOIN upper y ON w.up AND y.level = w.level AND y.pos = xor(w.pos, 1)
  LEFT JOIN subroots s ON s.g = w.g
  WHERE w.n > 1 OR NOT w.up),
ends AS (SELECT r, proof, folded FROM walk WHERE up AND n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM leaves JOIN ends USING (r) JOIN subroots USING (g) CROSS JOIN (SELECT h AS root FROM upper WHERE n = 1)
"""
