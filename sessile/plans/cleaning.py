"""Queries of text cleaning, keys, parsing and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessile.functions import clean as c
from sessile.roles import SQL, measurements, table


def clean_text(spark, sf_dir):
    """[P1 P2 P3] Digests of the cleaned text, its token and its bare token, over whole documents."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(c.clean_text("text")).alias("clean"), F.md5(c.normalised_token("text")).alias("token"), F.md5(c.bare_token("text")).alias("bare"))


def stable_ids(spark, sf_dir):
    """[P4 P8 P9] Both id recipes over parts; the third part is the first of several columns that is filled."""
    p = table(spark, sf_dir, "part")
    maybe = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("  "), F.col("p_brand")))
    third = c.first_filled(maybe, F.lit(" "), "p_type")
    return p.select("p_partkey", c.stable_id("SURF", ["p_name", F.col("p_size").cast("string"), third]).alias("surface_id"), c.stable_id("LIQ", [c.canonical_name("p_name")], 10).alias("liquid_id"), c.piped_id("REC", ["p_name", third]).alias("record_id"))


SEGMENTS = {"building": "construction", "machinery": "equipment", "furniture": "household"}


def alias_canonical(spark, sf_dir):
    """[P5] Usual names of market segments, through a broadcast alias table."""
    d = table(spark, sf_dir, "customer").withColumn("token", c.normalised_token("c_mktsegment"))
    alias = spark.createDataFrame(list(SEGMENTS.items()), "token string, canonical string")
    return d.join(F.broadcast(alias), "token", "left").groupBy(F.coalesce("canonical", "token").alias("segment")).agg(F.count("*").alias("n"), F.countDistinct("token").alias("names"))


def numeric_parse(spark, sf_dir):
    """[P6 P7 S5a] Numbers of free text: whole, leading, and with a deviation; what is none becomes null."""
    d = table(spark, sf_dir, "events")
    text = F.concat(F.col("value").cast("decimal(18,2)").cast("string"), F.element_at(F.array(*[F.lit(x) for x in ("", " mN/m", " ± 2.5", " (1.5)", "e400", "x")]), (F.col("event_id") % 6 + 1).cast("int")))
    text = F.when(F.col("event_id") % 7 == 0, F.lit("n/a")).otherwise(text)
    parsed = c.value_with_deviation(text)
    return d.select("event_id", F.round(c.finite(text), 6).alias("whole"), F.round(c.leading_number(text), 6).alias("leading"), F.round(parsed["value"], 6).alias("value"), F.round(parsed["deviation"], 6).alias("deviation"))


ANGLES = ("Advancing angle", "receding", " static ", "Not specified", "capillary rise (Washburn)", "roughness-corrected", "apparent", "equilibrium", "sessile", "")


def classify_rules(spark, sf_dir):
    """[P10 P11 P14 P15] Families of document texts and of given angle labels, with size bins."""
    d = table(spark, sf_dir, "documents")
    label = F.element_at(F.array(*map(F.lit, ANGLES)), (F.col("doc_id") % len(ANGLES) + 1).cast("int"))
    size = c.right_closed_bin(F.char_length("text").cast("double"), (-0.5, 500, 2000, 10000, 1e12), ("short", "medium", "long", "very_long"))
    return d.select("doc_id", c.family("text").alias("family"), c.angle_type(label).alias("angle_type"), size.alias("size_bin"))


def list_roundtrip(spark, sf_dir):
    """[P19 P20 P21] Liquids of a surface as a list text, parsed again, and rendered with their mean angles."""
    m = measurements(spark, sf_dir, with_id=False)
    each = m.groupBy("surface_group_id", "liquid_name").agg(F.avg("angle").alias("mean"))
    g = each.groupBy("surface_group_id").agg(c.list_text(F.collect_list("liquid_name")).alias("liquids"), F.array_sort(F.collect_list(F.struct("liquid_name", F.format_string("%s: %s deg", "liquid_name", F.round("mean", 1).cast("decimal(8,1)").cast("string")).alias("t")))).alias("t"))
    back = c.list_of(F.concat("liquids", F.lit("; nan ;;")))
    return g.select("surface_group_id", "liquids", F.size(back).cast("long").alias("n"), F.array_join(F.transform("t", lambda x: x["t"]), "; ").alias("rendered"))


def legacy_normalise(spark, sf_dir):
    """[P22 P23 P24 P25 P26] Legacy rows: number casts, component fallbacks, an audit override, skip reasons, cohort labels."""
    m = measurements(spark, sf_dir).withColumn("polar", F.when(F.col("liquid_id") != 5, F.col("gp")))
    dispersion = F.when(F.col("liquid_id") % 3 != 0, F.col("gd"))
    lw = F.coalesce(dispersion, F.when(F.col("liquid_id") == 3, F.col("gamma") - F.col("gp")))
    plus = F.col("polar") / 2
    reasons = F.concat_ws(";", F.when(lw.isNull(), "missing_dispersion"), F.when(F.col("polar").isNull(), "missing_polar"), F.when(F.col("angle") > 170, "angle_range"))
    audit = F.when((F.col("surface_group_id") % 4 == 0) & lw.isNotNull(), F.round(F.col("gamma") * 0.9, 3))
    cohort = F.when(F.col("v4_split") == "train", "development").when(F.col("v4_split").isin("validation", "internal_test"), "internal").otherwise("external")
    return m.select("measurement_id", F.round(lw, 6).alias("lw"), F.round(plus, 6).alias("acid_plus"), F.coalesce(audit, F.col("gamma")).alias("total"), reasons.alias("skip_reason"), cohort.alias("cohort"), F.round(c.anchored("angle", F.col("score") - 5), 4).alias("anchored"))


def registry_defaults(spark, sf_dir):
    """[P33 S4] Blank cells take the registry's value; orders are looked up in the customer registry."""
    o = table(spark, sf_dir, "orders")
    reg = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    cell = F.when(F.col("o_orderkey") % 3 == 0, F.lit("  ")).when(F.col("o_orderkey") % 3 == 1, F.lit("own"))
    return o.join(reg, "o_custkey", "left").select("o_orderkey", F.coalesce(F.nullif(F.trim(cell), F.lit("")), "c_mktsegment", F.lit("unknown")).alias("segment"))


def label_decode(spark, sf_dir):
    """[P12 P18] Descriptions from parts of a name, and permissions of splits under both rule sets."""
    m = measurements(spark, sf_dir)
    n = F.col("solid_name")
    text = F.concat_ws("; ", F.when(n.contains("red"), "colour red"), F.when(n.contains("small"), "small form"), F.when(n.contains("ring"), "ring shape"), F.when(n.contains("widget"), "widget"))
    p, q = c.permissions("v4_split"), c.permissions("v4_split", True)
    return m.select("measurement_id", text.alias("description"), p["training"].alias("training"), p["tuning"].alias("tuning"), p["evaluation"].alias("evaluation"), q["tuning"].alias("tuning_2"), q["evaluation"].alias("evaluation_2"))


QUERIES = {f.__name__: f for f in (clean_text, stable_ids, alias_canonical, numeric_parse, classify_rules, list_roundtrip, legacy_normalise, registry_defaults, label_decode)}


def _clean(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'))"


_FAMILY = "CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce(text, '')), '{'|'.join(w)}') THEN '{f}'" for f, w in c.FAMILY_WORDS) + " ELSE 'other' END"
_ALIAS = "CASE {t} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in c.ALIASES.items()) + " ELSE {t} END"
_LABELS = "[" + ", ".join(f"'{a}'" for a in ANGLES) + "]"
_N = r"([-+]?[0-9]+(?:\.[0-9]+)?)"
ORACLES = {
    "clean_text": f"SELECT doc_id, md5({_clean('text')}) AS clean, md5(lower({_clean('text')})) AS token, md5(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '', 'g')) AS bare FROM documents",
    "stable_ids": f"""WITH p AS (SELECT *, CASE WHEN p_size % 3 = 0 THEN trim(p_brand) ELSE p_type END AS third FROM part)
SELECT p_partkey, 'SURF_' || upper(substr(sha256(concat_ws(chr(31), lower({_clean('p_name')}), p_size::VARCHAR, lower({_clean('third')}))), 1, 12)) AS surface_id,
  'LIQ_' || upper(substr(sha256({_ALIAS.format(t=f"lower({_clean('p_name')})")}), 1, 10)) AS liquid_id,
  'REC_' || upper(substr(sha256(lower(trim(p_name)) || '|' || lower(trim(third))), 1, 12)) AS record_id FROM p""",
    "alias_canonical": "SELECT CASE lower(c_mktsegment) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SEGMENTS.items()) + " ELSE lower(c_mktsegment) END AS segment, count(*) AS n, count(DISTINCT lower(c_mktsegment)) AS names FROM customer GROUP BY 1",
    "numeric_parse": rf"""WITH t AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE value::DECIMAL(18,2)::VARCHAR || ['', ' mN/m', ' ± 2.5', ' (1.5)', 'e400', 'x'][event_id % 6 + 1] END AS t FROM events),
w AS (SELECT *, TRY_CAST(t AS DOUBLE) AS d FROM t)
SELECT event_id, CASE WHEN isnan(d) OR isinf(d) THEN NULL ELSE round(d, 6) END AS whole, round(TRY_CAST(nullif(regexp_extract(t, '^([-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+))', 1), '') AS DOUBLE), 6) AS leading,
  round(TRY_CAST(coalesce(nullif(regexp_extract(t, '^{_N} ?± ?{_N}$', 1), ''), nullif(regexp_extract(t, '^{_N} ?\({_N}\)$', 1), ''), nullif(regexp_extract(t, '^{_N}$', 1), '')) AS DOUBLE), 6) AS value,
  round(TRY_CAST(coalesce(nullif(regexp_extract(t, '^{_N} ?± ?{_N}$', 2), ''), nullif(regexp_extract(t, '^{_N} ?\({_N}\)$', 2), '')) AS DOUBLE), 6) AS deviation FROM w""",
    "classify_rules": f"""WITH d AS (SELECT *, lower({_clean(f'{_LABELS}[doc_id % {len(ANGLES)} + 1]')}) AS t, length(text) AS n FROM documents)
SELECT doc_id, {_FAMILY} AS family, CASE WHEN t = '' OR contains(t, 'not specified') OR contains(t, 'unspecified') THEN 'reported_unspecified' WHEN contains(t, 'advanc') THEN 'advancing' WHEN contains(t, 'reced') THEN 'receding'
  WHEN contains(t, 'equilibrium') THEN 'equilibrium' WHEN contains(t, 'capillary') OR contains(t, 'washburn') THEN 'capillary_rise_derived' WHEN contains(t, 'roughness') AND contains(t, 'correct') THEN 'roughness_corrected_apparent'
  WHEN contains(t, 'apparent') THEN 'apparent' WHEN contains(t, 'static') THEN 'static' ELSE t END AS angle_type,
  CASE WHEN n IS NULL THEN NULL WHEN n <= 500 THEN 'short' WHEN n <= 2000 THEN 'medium' WHEN n <= 10000 THEN 'long' ELSE 'very_long' END AS size_bin FROM d""",
    "list_roundtrip": SQL + """, e AS (SELECT surface_group_id, liquid_name, avg(angle) AS mean FROM m GROUP BY ALL)
SELECT surface_group_id, string_agg(liquid_name, ';' ORDER BY liquid_name) AS liquids, count(*) AS n, string_agg(liquid_name || ': ' || round(mean, 1)::DECIMAL(8,1)::VARCHAR || ' deg', '; ' ORDER BY liquid_name) AS rendered FROM e GROUP BY 1""",
    "legacy_normalise": SQL + """, x AS (SELECT *, CASE WHEN liquid_id % 3 <> 0 THEN gd WHEN liquid_id = 3 THEN gamma - gp END AS lw, CASE WHEN liquid_id <> 5 THEN gp END AS polar FROM m)
SELECT measurement_id, round(lw, 6) AS lw, round(polar / 2, 6) AS acid_plus, CASE WHEN surface_group_id % 4 = 0 AND lw IS NOT NULL THEN round(gamma * 0.9::DOUBLE, 3) ELSE gamma END AS total,
  concat_ws(';', CASE WHEN lw IS NULL THEN 'missing_dispersion' END, CASE WHEN polar IS NULL THEN 'missing_polar' END, CASE WHEN angle > 170 THEN 'angle_range' END) AS skip_reason,
  CASE WHEN v4_split = 'train' THEN 'development' WHEN v4_split IN ('validation', 'internal_test') THEN 'internal' ELSE 'external' END AS cohort, round(least(greatest(angle + (score - 5), 0), 180), 4) AS anchored FROM x""",
    "registry_defaults": "SELECT o_orderkey, coalesce(nullif(trim(CASE o_orderkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN 'own' END), ''), c_mktsegment, 'unknown') AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
    "label_decode": SQL + """SELECT measurement_id, concat_ws('; ', CASE WHEN contains(solid_name, 'red') THEN 'colour red' END, CASE WHEN contains(solid_name, 'small') THEN 'small form' END, CASE WHEN contains(solid_name, 'ring') THEN 'ring shape' END, CASE WHEN contains(solid_name, 'widget') THEN 'widget' END) AS description,
  CASE WHEN v4_split = 'train' THEN 'yes' ELSE 'no' END AS training, CASE WHEN v4_split = 'validation' THEN 'yes' ELSE 'no' END AS tuning, CASE WHEN v4_split IN ('train', 'validation') THEN 'no' ELSE 'yes' END AS evaluation,
  CASE WHEN v4_split IN ('train', 'validation') THEN 'yes' ELSE 'no' END AS tuning_2, CASE WHEN v4_split IN ('train', 'validation') THEN 'no' ELSE 'yes' END AS evaluation_2 FROM m""",
}
