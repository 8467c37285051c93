"""Queries of quality rules, curation, merges and profiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sessile import sources as src
from sessile.functions import clean as c
from sessile.operators import joins, quality
from sessile.roles import SQL, measurements, table


def import_rules(spark, sf_dir):
    """[Q4 O5]"""
    m = measurements(spark, sf_dir)
    rules = {"angle_range": quality.outside("angle", 0, 175), "no_polar_part": F.col("gp") <= 0, "not_eligible": F.col("target_eligible") == "no", "uncertain": F.col("score") > 10, "no_name": F.trim("solid_name") == ""}
    return quality.broken_rules(m, rules, "measurement_id")


def star_validation(spark, sf_dir):
    """[Q5 A26 Q8] Counts of the star and of sources, surfaces and orders that cross splits, in one row for each check."""
    m = measurements(spark, sf_dir, with_id=False).withColumnRenamed("l_orderkey", "order_id")
    crossing = [m.groupBy(k).agg(F.count_distinct("v4_split").alias("s")).agg(F.lit(k).alias("key"), F.count("*").alias("n"), F.count_if(F.col("s") > 1).alias("crossing")) for k in ("source_group_id", "surface_group_id", "liquid_id", "order_id")]
    return crossing[0].union(crossing[1]).union(crossing[2]).union(crossing[3])


def decision_gate(spark, sf_dir):
    """[Q6 Q7 U2] Violations of a decision table over the suppliers."""
    s = table(spark, sf_dir, "supplier").withColumn("source", F.col("s_suppkey"))
    decision = F.element_at(F.array(*map(F.lit, ("retain", "exclude", "pending_review", "retain_reextracted", "retain"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    d = s.filter("s_suppkey % 11 <> 0").select("source", decision.alias("decision"))
    d = d.unionByName(d.filter("source % 13 = 0"))
    d = d.unionByName(d.filter("source % 17 = 0").withColumn("source", F.col("source") + 1000000))  # doubled ones too
    return quality.decision_violations(d, s.select("source"), s.filter("s_nationkey % 2 = 0").select("source"))


def identity_unique(spark, sf_dir):
    """[Q9 W3 J10] Part names that several brands share, after normalising."""
    p = table(spark, sf_dir, "part").filter("p_size > 5").select("p_partkey", "p_brand", c.normalised_token("p_name").alias("name"))
    return quality.repeated(p.select("name", "p_brand").distinct(), ["name"]).groupBy("name").agg(F.count("*").alias("brands"), F.min("p_brand").alias("first_brand"))


def row_expectations(spark, sf_dir):
    """[Q10 Q11]"""
    m = measurements(spark, sf_dir, with_id=False)
    yes = lambda x: F.count_if(x)
    return quality.expectations(m, {
        "angles_out_of_range": (yes(quality.outside("angle", 0, 180)), 0, 0), "blank_names": (yes(F.trim("solid_name") == ""), 0, 0), "splits": (F.count_distinct("v4_split"), 5, 0), "liquids": (F.count_distinct("liquid_id"), 7, 0),
        "mean_angle": (F.avg("angle"), 91.8, 1.0), "bad_flags": (yes(~F.col("target_eligible").isin("yes", "no")), 0, 0), "clipped": (yes(F.col("pred_a") >= 180), 0, 10),
    })


def semantic_dups(spark, sf_dir):
    """[W2 W4 J5 P3] Labels of measurements that share liquid and solid name, in both modes."""
    m = measurements(spark, sf_dir).withColumn("solid", c.bare_token(F.concat_ws(" ", "solid_name", "surface_group_id"))).withColumn("value", F.when(F.col("score") < 11, F.round("angle", 6)))
    found = quality.duplicate_groups(m.select("solid", "liquid_id", "value", "source_group_id"), ["solid", "liquid_id"], "value", "source_group_id")
    modes = F.inline(F.array(*[F.struct(quality.duplicate_label("value", compat).alias("label"), F.lit(compat).alias("compat")) for compat in (False, True)]))
    return found.select("sources", modes).groupBy("label", "compat").agg(F.count("*").alias("n"), F.count_if(F.col("sources") > 1).alias("across"))


def multi_source_union(spark, sf_dir):
    """[S3 U1] Customers and suppliers as one table; their headers differ."""
    a = table(spark, sf_dir, "customer").withColumn("file", F.lit("customer"))
    b = table(spark, sf_dir, "supplier").withColumn("file", F.lit("supplier"))
    alias = {"c_custkey": "key", "s_suppkey": "key", "c_name": "name", "s_name": "name", "c_nationkey": "nation", "s_nationkey": "nation", "c_acctbal": "balance", "s_acctbal": "balance", "c_mktsegment": "segment"}
    return src.read_many([a, b], alias, ["key", "name", "balance"]).select("file", "key", "name", "nation", "balance", F.coalesce("segment", F.lit("")).alias("segment"))


def recurate(spark, sf_dir):
    """[Q15 J9 J10 J13 P27 Q17] Decisions applied: sources removed, replaced by new rows, or corrected; rows by source and state."""
    m = measurements(spark, sf_dir, with_id=False).select("source_group_id", "liquid_id", "angle", "score", "target_eligible")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_group_id"), F.col("s_nationkey").alias("nation"))
    decided = s.withColumn("decision", F.when(F.col("nation") % 6 == 0, "exclude").when(F.col("nation") % 6 == 1, "retain_reextracted").otherwise("retain"))
    gone = decided.filter("decision <> 'retain'").select("source_group_id")
    kept = m.join(gone, "source_group_id", "left_anti").withColumn("state", F.lit("kept"))
    fresh = m.join(decided.filter("decision = 'retain_reextracted'").select("source_group_id"), "source_group_id", "left_semi")
    fresh = fresh.filter((F.col("score") <= 9) | (F.col("target_eligible") == "no")).withColumn("angle", F.round("angle")).withColumn("state", F.lit("replaced"))
    rules = decided.filter("nation % 6 = 2").select("source_group_id", F.lit(0.5).alias("shift"))
    both = kept.unionByName(fresh).join(F.broadcast(rules) if rules.count() < 100_000 else rules, "source_group_id", "left")
    both = both.withColumn("angle", F.col("angle") + F.coalesce("shift", F.lit(0.0))).withColumn("eligible", F.when((F.col("state") == "replaced") & (F.col("score") > 9), "no").otherwise(F.col("target_eligible")))
    return both.groupBy("source_group_id", "state").agg(F.count("*").alias("n"), F.count_if(F.col("eligible") == "yes").alias("eligible"), F.round(F.sum("angle"), 4).alias("angles"))


def merge_insert_absent(spark, sf_dir):
    """[J14 Q16] Staged order lines whose (order, line) the table lacks; the first of a key in the batch counts."""
    line = table(spark, sf_dir, "lineitem")
    have = line.filter("l_suppkey % 3 = 0").select("l_orderkey", "l_linenumber")
    staged = line.filter("l_suppkey % 3 <> 0").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    order = [F.col(x) for x in ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    return joins.insert_absent(have, staged, ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


def _upsert_sides(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    old = p.filter("p_partkey % 5 <> 0").select("p_partkey", "p_brand", F.col("p_size").cast("long").alias("p_size"), "p_type")
    new = p.filter("p_partkey % 3 = 0").select("p_partkey", F.concat("p_brand", F.lit("*")).alias("p_brand"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("long") + 100).alias("p_size"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_type")).alias("p_type"))
    return old, new


def upsert_last(spark, sf_dir):
    """[J15] A staged row replaces the whole row."""
    return joins.upsert(*_upsert_sides(spark, sf_dir), ["p_partkey"], keep_known=False)


def upsert_coalesce(spark, sf_dir):
    """[J15] Nulls of a staged row leave known values."""
    return joins.upsert(*_upsert_sides(spark, sf_dir), ["p_partkey"])


def content_manifest(spark, sf_dir):
    """[S8 S9] Fingerprints and row counts of tables, whatever the order of rows."""
    out = None
    for name, cols in {"part": ["p_partkey", "p_name", "p_brand", "p_size"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus"], "documents": ["doc_id", "text"], "nation": ["n_nationkey", "n_name"]}.items():
        d = table(spark, sf_dir, name).agg(F.lit(name).alias("table"), F.count("*").alias("n"), src.fingerprint(cols).cast("long").alias("fingerprint"))
        out = d if out is None else out.unionByName(d)
    return out


def source_manifest(spark, sf_dir):
    """[S10] Retained and excluded rows by source beside the registry."""
    m = measurements(spark, sf_dir, with_id=False)
    g = m.groupBy("source_group_id").agg(F.count_if(F.col("target_eligible") == "yes").alias("retained"), F.count_if(F.col("target_eligible") == "no").alias("excluded"))
    reg = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_group_id"), "s_name")
    return reg.join(g, "source_group_id", "left").na.fill(0, ["retained", "excluded"])


def table_extract(spark, sf_dir):
    """[S5 S5a S5b] Cells of repeated markup by a table of specs, over all pages; cells that do not parse are counted by reason."""
    pages = table(spark, sf_dir, "pages")
    spec = spark.createDataFrame([("menu", r'<li><a href="[^"]*">([^<]*)</a></li>', 2), ("paragraph", "<p>([^<]*)</p>", 4)], "spec string, pattern string, least int")
    cells = pages.crossJoin(F.broadcast(spec)).select("page_id", "spec", "least", F.posexplode(F.expr("regexp_extract_all(coalesce(html, ''), pattern, 1)")).alias("at", "cell"))
    text = c.clean_text("cell")
    reason = F.when(text == "", "empty").when(F.char_length(text) < F.col("least"), "too_short").when(text.rlike("^[0-9]"), "number").otherwise("kept")
    return cells.withColumn("reason", reason).groupBy("spec", "reason").agg(F.count("*").alias("n"), F.sum(F.char_length(text)).alias("chars"), F.max("at").alias("last"))


def star_lookup(spark, sf_dir):
    """[J4 J5 J6 J7 S4] Items through orders, customers, nations and regions."""
    line, o, cu, n, r = (table(spark, sf_dir, x) for x in ("lineitem", "orders", "customer", "nation", "region"))
    n = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    d = line.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(cu, F.col("o_custkey") == F.col("c_custkey"), "left").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return d.groupBy("r_name", "c_mktsegment").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"), F.round(F.sum("l_quantity"), 4).alias("quantity"))


def manifest_enrich(spark, sf_dir):
    """[J16 P25] Rows of sources in a manifest, with their audit where there is one; excluded sources go."""
    m = measurements(spark, sf_dir)
    s = table(spark, sf_dir, "supplier")
    manifest = s.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("source_group_id"), F.when(F.col("s_nationkey") % 7 == 0, "excluded").otherwise("included").alias("status"))
    audit = table(spark, sf_dir, "part").filter("p_size % 2 = 0").groupBy("p_size").agg(F.max("p_retailprice").alias("audit"))
    d = m.join(manifest, "source_group_id").filter("status <> 'excluded'").withColumn("p_size", (F.col("surface_group_id") % 100).cast("int")).join(audit, "p_size", "left")
    return d.select("measurement_id", F.coalesce(F.round(F.col("audit") / 100, 4), F.round("angle", 4)).alias("value"), F.when(F.col("audit").isNotNull(), "audit").otherwise("measured").alias("origin"))


def array_exclusion(spark, sf_dir):
    """[J11] Conversations by whether a role takes part, from lists of roles."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("roles"), F.count("*").alias("turns"))
    return t.filter(~F.array_contains("roles", "system")).select("conv_id", F.array_join("roles", ",").alias("roles"), "turns")


def set_checks(spark, sf_dir):
    """[U2 U3 U4 U5] Sizes of set operations on customers and order customers."""
    a = table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"))
    b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    parts = {"both": a.intersect(b), "only_first": a.subtract(b), "only_second": b.subtract(a), "second": b.distinct()}
    out = None
    for name, d in parts.items():
        d = d.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.min("k").alias("least"), F.max("k").alias("most"))
        out = d if out is None else out.unionByName(d)
    return out


PRIORITIES = ("5-LOW", "3-MEDIUM", "1-URGENT", "2-HIGH", "4-NOT SPECIFIED")


def custom_order(spark, sf_dir):
    """[O6] Counts by priority with their place in a given order."""
    o = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    place = F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("o_orderpriority"))
    return o.withColumn("place", place).orderBy("place")


def first_in_group(spark, sf_dir):
    """[A1 A2] First event of each user, and the first values that are not blank."""
    e = table(spark, sf_dir, "events")
    first = joins.first_rows(e.select("user_id", "event_id", "event_type", "value"), ["user_id"], ["event_id"])
    blank = e.withColumn("kind", F.when(F.col("event_id") % 3 == 0, F.lit(" ")).otherwise(F.col("event_type"))).withColumn("big", F.when(F.col("value") > 50, F.col("value").cast("decimal(12,2)").cast("string")))
    return first.join(joins.first_filled(blank, ["user_id"], ["kind", "big"], "event_id"), "user_id")


def row_ordinal(spark, sf_dir):
    """[W7] Turn numbers within conversations, counted again."""
    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) + 1).alias("line"))


def star_migration(spark, sf_dir):
    """[Q1 A1 P8 P9] A flat table to dimensions with content keys: surfaces with their first filled values."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    flat = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_name", "p_type", "p_brand", "p_partkey", F.when(F.col("p_size") % 4 != 0, F.col("p_type")).alias("family"))
    flat = flat.withColumn("surface_id", c.stable_id("SURF", [F.col("l_suppkey").cast("string"), "p_name"]))
    return joins.first_filled(flat, ["surface_id"], ["family", "p_brand"], "p_partkey")


def cohort_profile(spark, sf_dir):
    """[A3 A4]"""
    m = measurements(spark, sf_dir, with_id=False)
    return m.groupBy("v4_split").agg(F.count("*").alias("n"), *[F.count_distinct(k).alias(a) for k, a in (("source_group_id", "sources"), ("surface_group_id", "surfaces"), ("liquid_id", "liquids"))])


def category_profile(spark, sf_dir):
    """[A5]"""
    m = measurements(spark, sf_dir, with_id=False)
    return m.unpivot([], ["v4_split", "solid_family", "liquid_name", "target_eligible"], "field", "value").groupBy("field", "value").agg(F.count("*").alias("n"))


def completeness(spark, sf_dir):
    """[A6 A7] Share of values present by column, and of rows with any of them."""
    m = measurements(spark, sf_dir, with_id=False).select(F.when(F.col("score") < 9, F.col("angle")).alias("angle"), F.when(F.col("liquid_id") != 2, F.col("gp")).alias("gp"), F.when(F.col("target_eligible") == "yes", F.col("pred_a")).alias("pred_a"))
    cols = ["angle", "gp", "pred_a"]
    row = m.agg(*[F.round(F.count(x) / F.count("*"), 6).alias(x) for x in cols], F.round(F.avg(F.coalesce(*cols).isNotNull().cast("double")), 6).alias("any"))
    return row.unpivot([], [*cols, "any"], "field", "share")


_OWN = "import_rules star_validation decision_gate identity_unique row_expectations semantic_dups multi_source_union recurate merge_insert_absent upsert_last upsert_coalesce content_manifest source_manifest table_extract star_lookup manifest_enrich array_exclusion set_checks custom_order first_in_group row_ordinal star_migration cohort_profile category_profile completeness"
QUERIES = {k: globals()[k] for k in _OWN.split()}

_UP = """WITH o AS (SELECT p_partkey, p_brand, p_size::BIGINT AS p_size, p_type FROM part WHERE p_partkey % 5 <> 0),
n AS (SELECT p_partkey, p_brand || '*' AS p_brand, CASE WHEN p_partkey % 2 = 0 THEN p_size::BIGINT + 100 END AS p_size, CASE WHEN p_partkey % 4 = 0 THEN p_type END AS p_type FROM part WHERE p_partkey % 3 = 0)
"""
_FP = "('0x' || substr(md5(concat_ws('|', {})), 1, 8))::BIGINT"
ORACLES = {
    "import_rules": SQL + """, h AS (SELECT 'angle_range' AS rule, measurement_id FROM m WHERE NOT coalesce(angle BETWEEN 0 AND 175, false) UNION ALL SELECT 'no_polar_part', measurement_id FROM m WHERE gp <= 0
  UNION ALL SELECT 'not_eligible', measurement_id FROM m WHERE target_eligible = 'no' UNION ALL SELECT 'uncertain', measurement_id FROM m WHERE score > 10 UNION ALL SELECT 'no_name', measurement_id FROM m WHERE trim(solid_name) = ''),
r AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY measurement_id) AS rn FROM h)
SELECT rule, count(*) AS n, string_agg(measurement_id::VARCHAR, ',' ORDER BY measurement_id) FILTER (WHERE rn <= 20) AS first_ids FROM r GROUP BY 1""",
    "star_validation": SQL + " UNION ALL ".join(f"SELECT '{k}' AS key, count(*) AS n, count(*) FILTER (WHERE s > 1) AS crossing FROM (SELECT count(DISTINCT v4_split) AS s FROM m GROUP BY {e})" for k, e in (("source_group_id", "source_group_id"), ("surface_group_id", "surface_group_id"), ("liquid_id", "liquid_id"), ("order_id", "l_orderkey"))),
    "decision_gate": """WITH d0 AS (SELECT s_suppkey AS source, ['retain', 'exclude', 'pending_review', 'retain_reextracted', 'retain'][s_suppkey % 5 + 1] AS decision FROM supplier WHERE s_suppkey % 11 <> 0),
d AS (SELECT * FROM d0 UNION ALL SELECT * FROM d0 WHERE source % 13 = 0 UNION ALL SELECT source + 1000000, decision FROM d0 WHERE source % 17 = 0 UNION ALL SELECT source + 1000000, decision FROM d0 WHERE source % 13 = 0 AND source % 17 = 0)
SELECT source, 'decided_twice' AS kind FROM d GROUP BY 1 HAVING count(*) > 1 UNION SELECT source, 'pending' FROM d WHERE decision LIKE 'pending%' UNION SELECT source, 'unknown_source' FROM d WHERE source NOT IN (SELECT s_suppkey FROM supplier)
UNION SELECT source, 'no_replacement' FROM d WHERE decision = 'retain_reextracted' AND source NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey % 2 = 0) UNION SELECT s_suppkey, 'undecided' FROM supplier WHERE s_suppkey NOT IN (SELECT source FROM d)""",
    "identity_unique": "WITH p AS (SELECT DISTINCT lower(trim(p_name)) AS name, p_brand FROM part WHERE p_size > 5) SELECT name, count(*) AS brands, min(p_brand) AS first_brand FROM p GROUP BY 1 HAVING count(*) > 1",
    "row_expectations": SQL + """, a AS (SELECT count(*) FILTER (WHERE NOT coalesce(angle BETWEEN 0 AND 180, false))::DOUBLE AS a1, count(*) FILTER (WHERE trim(solid_name) = '')::DOUBLE AS a2, count(DISTINCT v4_split)::DOUBLE AS a3, count(DISTINCT liquid_id)::DOUBLE AS a4, round(avg(angle), 6) AS a5,
  count(*) FILTER (WHERE target_eligible NOT IN ('yes', 'no'))::DOUBLE AS a6, count(*) FILTER (WHERE pred_a >= 180)::DOUBLE AS a7 FROM m)
SELECT c AS "check", e::DOUBLE AS expected, v AS actual, abs(v - e) <= t AS pass FROM a, LATERAL (VALUES ('angles_out_of_range', 0.0::DOUBLE, a1, 0.0::DOUBLE), ('blank_names', 0, a2, 0), ('splits', 5, a3, 0), ('liquids', 7, a4, 0), ('mean_angle', 91.8, a5, 1), ('bad_flags', 0, a6, 0), ('clipped', 0, a7, 10)) x(c, e, v, t)""",
    "semantic_dups": SQL + """, x AS (SELECT regexp_replace(lower(solid_name || ' ' || surface_group_id), '[^a-z0-9]+', '', 'g') AS solid, liquid_id, CASE WHEN score < 11 THEN round(angle, 6) END AS value, source_group_id FROM m),
g AS (SELECT solid, liquid_id, count(*) AS size, count(DISTINCT source_group_id) AS s, max(value) - min(value) AS w FROM x GROUP BY ALL),
y AS (SELECT x.*, size, s, w, count(*) OVER (PARTITION BY x.solid, x.liquid_id, value) AS same FROM x JOIN g ON x.solid = g.solid AND x.liquid_id = g.liquid_id)
SELECT CASE WHEN same > 1 THEN 'exact_duplicate' WHEN size > 1 AND w <= 1 THEN 'near_duplicate' WHEN size > 1 THEN 'repeated' ELSE 'unique' END AS label, count(*) AS n, count(*) FILTER (WHERE s > 1) AS across, false AS compat FROM y GROUP BY 1
UNION ALL SELECT CASE WHEN same < 2 THEN 'unique' WHEN value IS NOT NULL THEN 'near_duplicate' ELSE 'exact_duplicate' END, count(*), count(*) FILTER (WHERE s > 1), true FROM y GROUP BY 1""",
    "multi_source_union": "SELECT 'customer' AS file, c_custkey AS key, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, coalesce(c_mktsegment, '') AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, s_nationkey, s_acctbal, '' FROM supplier",
    "recurate": SQL + """, d AS (SELECT s_suppkey AS k, s_nationkey % 6 AS x FROM supplier),
b AS (SELECT source_group_id, 'kept' AS state, angle, target_eligible AS e, x FROM m JOIN d ON k = source_group_id WHERE x NOT IN (0, 1)
  UNION ALL SELECT source_group_id, 'replaced', round(angle), CASE WHEN score > 9 THEN 'no' ELSE target_eligible END, x FROM m JOIN d ON k = source_group_id WHERE x = 1 AND (score <= 9 OR target_eligible = 'no'))
SELECT source_group_id, state, count(*) AS n, count(*) FILTER (WHERE e = 'yes') AS eligible, round(sum(angle + CASE WHEN x = 2 THEN 0.5::DOUBLE ELSE 0 END), 4) AS angles FROM b GROUP BY ALL""",
    "merge_insert_absent": """WITH s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS rn FROM lineitem WHERE l_suppkey % 3 <> 0
  AND NOT EXISTS (SELECT 1 FROM lineitem h WHERE h.l_suppkey % 3 = 0 AND h.l_orderkey = lineitem.l_orderkey AND h.l_linenumber = lineitem.l_linenumber))
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM s WHERE rn = 1""",
    "upsert_last": _UP + "SELECT * FROM n UNION ALL SELECT * FROM o WHERE p_partkey NOT IN (SELECT p_partkey FROM n)",
    "upsert_coalesce": _UP + "SELECT coalesce(n.p_partkey, o.p_partkey) AS p_partkey, coalesce(n.p_brand, o.p_brand) AS p_brand, coalesce(n.p_size, o.p_size) AS p_size, coalesce(n.p_type, o.p_type) AS p_type FROM n FULL JOIN o ON n.p_partkey = o.p_partkey",
    "content_manifest": " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n, sum({_FP.format(', '.join(f'coalesce({x}::VARCHAR, chr(126))' for x in k))})::BIGINT AS fingerprint FROM {t}" for t, k in (("part", ("p_partkey", "p_name", "p_brand", "p_size")), ("orders", ("o_orderkey", "o_custkey", "o_orderstatus")), ("documents", ("doc_id", "text")), ("nation", ("n_nationkey", "n_name")))),
    "source_manifest": SQL + "SELECT s_suppkey AS source_group_id, s_name, count(*) FILTER (WHERE target_eligible = 'yes') AS retained, count(*) FILTER (WHERE target_eligible = 'no') AS excluded FROM supplier LEFT JOIN m ON s_suppkey = source_group_id GROUP BY ALL",
    "table_extract": r"""WITH s AS (SELECT page_id, 'menu' AS spec, 2 AS least, regexp_extract_all(coalesce(html, ''), '<li><a href="[^"]*">([^<]*)</a></li>', 1) AS l FROM pages UNION ALL SELECT page_id, 'paragraph', 4, regexp_extract_all(coalesce(html, ''), '<p>([^<]*)</p>', 1) FROM pages),
x AS (SELECT spec, least, unnest(l) AS cell, unnest(range(len(l))) AS pos FROM s), y AS (SELECT *, trim(regexp_replace(cell, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM x)
SELECT spec, CASE WHEN t = '' THEN 'empty' WHEN length(t) < least THEN 'too_short' WHEN regexp_matches(t, '^[0-9]') THEN 'number' ELSE 'kept' END AS reason, count(*) AS n, sum(length(t))::BIGINT AS chars, max(pos)::INT AS last FROM y GROUP BY ALL""",
    "star_lookup": "SELECT r_name, c_mktsegment, count(*) AS n, count(DISTINCT o_custkey) AS customers, round(sum(l_quantity), 4) AS quantity FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "manifest_enrich": SQL + """, a AS (SELECT p_size, max(p_retailprice) AS audit FROM part WHERE p_size % 2 = 0 GROUP BY 1)
SELECT measurement_id, coalesce(round(audit / 100, 4), round(angle, 4)) AS value, CASE WHEN audit IS NOT NULL THEN 'audit' ELSE 'measured' END AS origin FROM m JOIN supplier ON s_suppkey = source_group_id AND s_acctbal > 0 AND s_nationkey % 7 <> 0 LEFT JOIN a ON p_size = surface_group_id % 100""",
    "array_exclusion": "SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, count(*) AS turns FROM conversations GROUP BY 1 HAVING count(*) FILTER (WHERE role = 'system') = 0",
    "set_checks": """WITH a AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT o_custkey AS k FROM orders)
SELECT 'both' AS part, count(*) AS n, min(k) AS least, max(k) AS most FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'only_first', count(*), min(k), max(k) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)
UNION ALL SELECT 'only_second', count(*), min(k), max(k) FROM (SELECT k FROM b EXCEPT SELECT k FROM a) UNION ALL SELECT 'second', count(DISTINCT k), min(k), max(k) FROM b""",
    "custom_order": "SELECT o_orderpriority, count(*) AS n, list_position([" + ", ".join(f"'{p}'" for p in PRIORITIES) + "], o_orderpriority)::BIGINT AS place FROM orders GROUP BY 1",
    "first_in_group": """WITH f AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)
SELECT f.user_id, event_id, event_type, value, coalesce((SELECT arg_min(event_type, event_id) FROM events e WHERE e.user_id = f.user_id AND event_id % 3 <> 0), '') AS kind, coalesce((SELECT arg_min(value::DECIMAL(12,2)::VARCHAR, event_id) FROM events e WHERE e.user_id = f.user_id AND value > 50), '') AS big FROM f WHERE rn = 1""",
    "row_ordinal": "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) + 1 AS line FROM conversations",
    "star_migration": """WITH x AS (SELECT 'SURF_' || upper(substr(sha256(l_suppkey::VARCHAR || chr(31) || lower(trim(p_name))), 1, 12)) AS surface_id, p_brand, p_partkey, CASE WHEN p_size % 4 <> 0 THEN p_type END AS family FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT surface_id, coalesce(arg_min(family, p_partkey) FILTER (WHERE family IS NOT NULL), '') AS family, arg_min(p_brand, p_partkey) AS p_brand FROM x GROUP BY 1""",
    "cohort_profile": SQL + "SELECT v4_split, count(*) AS n, count(DISTINCT source_group_id) AS sources, count(DISTINCT surface_group_id) AS surfaces, count(DISTINCT liquid_id) AS liquids FROM m GROUP BY 1",
    "category_profile": SQL + " UNION ALL ".join(f"SELECT '{k}' AS field, {k} AS value, count(*) AS n FROM m GROUP BY {k}" for k in ("v4_split", "solid_family", "liquid_name", "target_eligible")),
    "completeness": SQL + """, x AS (SELECT CASE WHEN score < 9 THEN angle END AS a, CASE WHEN liquid_id <> 2 THEN gp END AS g, CASE WHEN target_eligible = 'yes' THEN pred_a END AS p FROM m)
SELECT 'angle' AS field, round(count(a) / count(*), 6) AS share FROM x UNION ALL SELECT 'gp', round(count(g) / count(*), 6) FROM x UNION ALL SELECT 'pred_a', round(count(p) / count(*), 6) FROM x UNION ALL SELECT 'any', round(count(coalesce(a, g, p)) / count(*), 6) FROM x""",
}
