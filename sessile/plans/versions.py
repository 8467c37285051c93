"""Queries of committed versions: re-curation, merges, the guard against rebuilds, and loads of many files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessile import sources as src
from sessile.operators import recuration
from sessile.roles import SQL, measurements, table
from sessile.sources.versions import OverwriteError, VersionedTables
from sessile.sources.work import materialised, new_folder

EXTERNAL = ("legacy_external", "prospective_open_external")
OUTSIDE = f"split IN {EXTERNAL}"


def _union(parts):
    return reduce(DataFrame.unionByName, parts)


def _recurated(spark, sf_dir) -> VersionedTables:
    """Facts and sources as version 1, and what the decisions leave of them as version 2."""
    m = measurements(spark, sf_dir)
    facts = m.select("measurement_id", F.col("source_group_id").alias("source_id"), F.col("surface_group_id").cast("string").alias("key"), F.col("angle").alias("value"), F.lit(False).alias("censored"))
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name"))
    store = VersionedTables(spark, new_folder(spark, "recurated"))
    store.commit({"measurements": facts, "sources": sources}, "migrate")
    facts, sources = store.read("measurements"), store.read("sources")
    kind = F.col("source_id") % 5
    decisions = sources.select("source_id", F.when(kind == 0, recuration.EXCLUDE).when(kind == 1, recuration.REPLACE).when(kind == 2, recuration.CORRECT).otherwise(recuration.RETAIN).alias("decision"))
    i = F.col("measurement_id")
    replacements = facts.filter((kind == 1) & (i % 3 != 0)).select((-i).alias("measurement_id"), "source_id", "key", F.when(i % 4 != 0, F.round("value")).alias("value"), (i % 8 == 0).alias("censored"))
    corrections = facts.filter(i % 2 == 0).select("measurement_id", (F.col("value") + 0.5).alias("value"))
    store.commit(recuration.recurate(facts, sources, decisions, replacements, corrections, few=decisions.count() <= src.BROADCAST_ROWS), "recurate")
    return store


def recurated_tables(spark, sf_dir):
    """[Q15 Q1 S6] The rows that decisions keep, those they exclude with the reason, and the refreshed sources, read from the committed version."""
    store = _recurated(spark, sf_dir)
    text = lambda name, key, *more: store.read(name).select(F.lit(name).alias("table"), F.col(key).cast("string").alias("key"), F.concat_ws("|", *more).alias("detail"))
    value = F.coalesce(F.round(F.col("value") * 10).cast("long").cast("string"), F.lit("-"))
    return _union([text("measurements", "measurement_id", "origin", "state", value), text("excluded", "measurement_id", "origin", "reason", value), text("sources", "source_id", "name", "status", F.col("rows").cast("string")), text("manifest", "source_id", "decision", F.col("retained").cast("string"), F.col("excluded").cast("string"))])


def _merged(spark, sf_dir) -> VersionedTables:
    """The star of a third of the sources as version 1, the others merged as frozen external rows as version 2."""
    m = measurements(spark, sf_dir).select("measurement_id", F.col("l_orderkey").alias("key"), F.col("surface_group_id").alias("surface_id"), "liquid_id", F.col("source_group_id").alias("source_id"), F.col("angle").alias("value"), F.col("solid_family").alias("family"), "liquid_name")
    m = materialised(m, "star")  # each table of both versions reads them
    have, staged = m.filter("source_id % 3 = 0 AND liquid_id <> 7"), m.filter("source_id % 3 <> 0 OR liquid_id = 1")
    star = {
        "measurements": have.drop("family", "liquid_name"), "surfaces": have.groupBy("surface_id").agg(F.max("family").alias("family")), "liquids": have.groupBy("liquid_id").agg(F.max("liquid_name").alias("liquid_name")),
        "splits": have.select("measurement_id", F.lit("train").alias("split")), "flags": have.select("measurement_id", F.lit("yes").alias("training"), F.lit("no").alias("tuning"), F.lit("no").alias("evaluation"), F.lit("no").alias("frozen")),
    }
    store = VersionedTables(spark, new_folder(spark, "merged"))
    store.rebuild(star, "migrate", OUTSIDE)
    store.commit(recuration.merge_external({k: store.read(k) for k in star}, staged, "prospective_open_external"), "merge", OUTSIDE)
    return store


def merged_tables(spark, sf_dir):
    """[Q16 J14 J15 P12] All rows of the merged star: facts, surfaces, liquids, splits and flags."""
    store = _merged(spark, sf_dir)
    text = lambda name, key, *more: store.read(name).select(F.lit(name).alias("table"), F.col(key).cast("string").alias("key"), F.concat_ws("|", *more).alias("detail"))
    return _union([text("measurements", "measurement_id", *[F.col(k).cast("string") for k in ("key", "surface_id", "liquid_id", "source_id")]), text("surfaces", "surface_id", "family"), text("liquids", "liquid_id", "liquid_name"), text("splits", "measurement_id", "split"), text("flags", "measurement_id", "training", "tuning", "evaluation", "frozen")])


def version_log(spark, sf_dir):
    """[Q17 S8 S9] The manifests of the merged star, whether a rebuild of each version's last state is refused, and whether the stored tables are intact."""
    store = _merged(spark, sf_dir)
    try:
        store.rebuild({"measurements": store.read("measurements")}, "rebuild")
        refused = "no"
    except OverwriteError:
        refused = "yes"
    intact = store.verify().select("table", "intact")
    return store.log().join(intact, "table").select("version", "operation", "table", "rows", "external_rows", F.lit(refused).alias("rebuild_refused"), "intact")


def glob_files(spark, sf_dir):
    """[S3 S1] Orders in files under five headers, with other names, orders and extra columns, read by one pattern."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("order_id"), F.col("o_custkey").cast("string").alias("customer"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderpriority").alias("priority"))
    base, kind = new_folder(spark, "headers"), F.col("order_id").cast("long") % 5
    headers = [{}, {"order_id": "Order No"}, {"customer": "cust", "date": "day"}, {"priority": None}, {"order_id": "id", "customer": "cust"}]
    for k, names in enumerate(headers):
        part = o.filter(kind == k)
        columns = [F.col(c).alias(names.get(c, c)) for c in (part.columns if k % 2 else part.columns[::-1]) if names.get(c, c)]
        part.select(*columns, *([F.lit(" ").alias("note")] if k == 2 else [])).write.option("header", True).csv(f"{base}/kind={k}")
    read = src.read_glob(spark, f"{base}/kind=*/*.csv", {"Order No": "order_id", "id": "order_id", "cust": "customer", "day": "date"}, ["order_id", "customer", "date"])
    named = (F.col("_file").rlike(r"^part-.*\.csv$") & (F.col("_row") >= 1)).alias("named")
    return read.select("order_id", "customer", "date", "priority", named)


_OWN = "recurated_tables merged_tables version_log glob_files"
QUERIES = {k: globals()[k] for k in _OWN.split()}

_M = SQL + """, h AS (SELECT * FROM m WHERE source_group_id % 3 = 0 AND liquid_id <> 7), s AS (SELECT * FROM m WHERE source_group_id % 3 <> 0 OR liquid_id = 1),
i AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.l_orderkey = s.l_orderkey AND h.liquid_id = s.liquid_id) QUALIFY row_number() OVER (PARTITION BY l_orderkey, liquid_id ORDER BY measurement_id) = 1),
o AS (SELECT surface_group_id AS k, max(solid_family) AS f FROM h GROUP BY 1), n AS (SELECT surface_group_id AS k, max(solid_family) AS f FROM s GROUP BY 1),
t AS (SELECT 'measurements' AS "table", measurement_id::VARCHAR AS key, concat_ws('|', l_orderkey, surface_group_id, liquid_id, source_group_id) AS detail, 'fact' AS x, 1 AS v FROM h UNION ALL SELECT 'measurements', measurement_id::VARCHAR, concat_ws('|', l_orderkey, surface_group_id, liquid_id, source_group_id), 'fact', 2 FROM i
UNION ALL SELECT 'splits', measurement_id::VARCHAR, 'train', '', 1 FROM h UNION ALL SELECT 'splits', measurement_id::VARCHAR, 'prospective_open_external', 'out', 2 FROM i
UNION ALL SELECT 'flags', measurement_id::VARCHAR, 'yes|no|no|no', '', 1 FROM h UNION ALL SELECT 'flags', measurement_id::VARCHAR, 'no|no|yes|yes', '', 2 FROM i
UNION ALL SELECT 'surfaces', k::VARCHAR, coalesce(n.f, o.f), '', CASE WHEN o.k IS NULL THEN 2 ELSE 1 END FROM o FULL JOIN n USING (k) UNION ALL SELECT 'liquids', liquid_id::VARCHAR, any_value(liquid_name), '', CASE WHEN bool_or(old) THEN 1 ELSE 2 END FROM (SELECT liquid_id, liquid_name, true AS old FROM h UNION SELECT liquid_id, liquid_name, false FROM s) GROUP BY 2)
"""
ORACLES = {
    "recurated_tables": SQL + """, f AS (SELECT measurement_id AS i, source_group_id AS s, angle AS v, CASE source_group_id % 5 WHEN 0 THEN 'exclude' WHEN 1 THEN 'replace' WHEN 2 THEN 'correct' ELSE 'retain' END AS d FROM m),
x AS (SELECT i, s, d, CASE WHEN d = 'correct' AND i % 2 = 0 THEN v + 0.5 ELSE v END AS v, CASE WHEN d = 'correct' AND i % 2 = 0 THEN 'corrected' ELSE 'original' END AS o, CASE d WHEN 'exclude' THEN 'excluded_by_decision' WHEN 'replace' THEN 'superseded' ELSE 'active' END AS t FROM f
  UNION ALL SELECT -i, s, d, CASE WHEN i % 4 <> 0 THEN round_even(v, 0) END, 'replacement', CASE WHEN i % 4 <> 0 THEN 'active' WHEN i % 8 = 0 THEN 'censored' ELSE 'no_value' END FROM f WHERE d = 'replace' AND i % 3 <> 0),
y AS (SELECT *, t IN ('excluded_by_decision', 'superseded', 'no_value') AS gone FROM x),
k AS (SELECT s_suppkey AS s, any_value(s_name) AS name, CASE s_suppkey % 5 WHEN 0 THEN 'exclude' WHEN 1 THEN 'replace' WHEN 2 THEN 'correct' ELSE 'retain' END AS d, count(*) FILTER (WHERE NOT gone) AS r, count(*) FILTER (WHERE gone) AS e FROM supplier LEFT JOIN y ON y.s = s_suppkey GROUP BY s_suppkey)
SELECT CASE WHEN gone THEN 'excluded' ELSE 'measurements' END AS "table", i::VARCHAR AS key, o || '|' || t || '|' || coalesce(round(v * 10)::BIGINT::VARCHAR, '-') AS detail FROM y
UNION ALL SELECT 'sources', s::VARCHAR, name || '|' || CASE WHEN r = 0 THEN 'empty' ELSE 'active' END || '|' || r FROM k WHERE d <> 'exclude' UNION ALL SELECT 'manifest', s::VARCHAR, d || '|' || r || '|' || e FROM k""",
    "merged_tables": _M + 'SELECT "table", key, detail FROM t',
    "version_log": _M + """SELECT v.version::INT AS version, CASE v.version WHEN 1 THEN 'migrate' ELSE 'merge' END AS operation, "table", count(*) AS rows, count(*) FILTER (WHERE x = 'out') AS external_rows, 'yes' AS rebuild_refused, true AS intact FROM t JOIN (VALUES (1), (2)) v(version) ON t.v <= v.version GROUP BY ALL""",
    "glob_files": "SELECT o_orderkey::VARCHAR AS order_id, o_custkey::VARCHAR AS customer, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderkey % 5 <> 3 THEN o_orderpriority END AS priority, true AS named FROM orders",
}
