"""Queries of contributed tables: grids of articles' tables, validation before staging."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessile.operators import grids, imports
from sessile.operators.grids import Measured, TableSpec
from sessile.roles import SQL, measurements, table


def _articles(spark, sf_dir):
    """Each order as an article: a table with two header rows, labels over two rows, cells over two columns, and nested tables."""
    line = table(spark, sf_dir, "lineitem")
    text = lambda c: F.col(c).cast("int").cast("string")
    td = lambda x, more="": F.concat(F.lit(f"<td{more}>"), x, F.lit("</td>"))
    nested = F.when(F.col("l_suppkey") % 3 == 0, "<table id='n'><tr><td>99</td><td>98</td></tr></table>").otherwise("")
    water = F.concat(td(text("l_quantity")), td(F.concat(F.lit("&#177; "), text("l_linenumber"), nested)))
    second = F.when(F.col("l_partkey") % 5 == 4, td(F.lit("n.d."), " colspan='2'")).otherwise(F.concat(td(F.concat(F.lit("<i>"), (F.col("l_quantity").cast("int") * 2).cast("string"), F.lit("</i>"))), td(text("l_linenumber"))))
    cells = F.when(F.col("l_partkey") % 7 == 0, water).otherwise(F.concat(water, second))
    one = line.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", cells.alias("cells")).alias("x"))
    rows = one.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.sort_array(F.collect_list("x")).alias("rows"))  # an order has a few lines
    label = lambda x, i: F.when(i % 2 == 0, F.concat(F.lit("<td rowspan=\"2\"> P"), x["l_partkey"].cast("string"), F.lit("</td>"))).otherwise(F.lit(""))
    body = F.array_join(F.transform("rows", lambda x, i: F.concat(F.lit("<tr>"), label(x, i), x["cells"], F.lit("</tr>"))), "")
    head = "<article><table-wrap id='t1'><caption>Costs</caption><table><tr><td>a</td><td>1</td></tr></table></table-wrap><table-wrap id='t2'><caption><p>Static contact <b>angles</b>, average &amp; SD</p></caption><table><thead><tr><th rowspan='2'>Specimen</th><th colspan='2'>Water</th><th colspan='2'>Formamide</th></tr><tr><th>CA</th><th>SD</th><th>CA</th><th>SD</th></tr></thead><tbody>"
    return rows.select("doc_id", F.concat(F.lit(head), body, F.lit("</tbody></table></table-wrap></article>")).alias("xml"))


GRID_SPEC = TableSpec((Measured("water", 1, 2), Measured("formamide", 3, 4)), caption=("contact angles", "average"), skip=2, exact=5, label_pattern="[A-Za-z]", constants=(("contact_angle_type", "static"),))


def table_grid_rows(spark, sf_dir):
    """[S5 S5a S5b] Measurement rows of tables with spans and nested tables, each with its label, value, deviation and reason."""
    found = grids.measurements_in(_articles(spark, sf_dir), GRID_SPEC)
    return found.select("doc_id", "table_id", "row", "label", "liquid", "value", "deviation", F.coalesce("reason", F.lit("kept")).alias("reason"), F.col("constants")["contact_angle_type"].alias("angle_type"))


def table_grid_report(spark, sf_dir):
    """[S5b] What each article gave: rows, labels, liquids, and the reasons of what was left."""
    found = grids.measurements_in(_articles(spark, sf_dir), GRID_SPEC)
    skipped = F.array_join(F.transform(F.map_entries("skipped"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return grids.report(found).select("doc_id", "n_rows", "n_labels", "n_liquids", F.coalesce(skipped, F.lit("")).alias("skipped"))


def _contributed(spark, sf_dir):
    """Line items as contributed tables, one a supplier, some with faults; and the registry of their sources."""
    m = measurements(spark, sf_dir)
    s, i = F.col("source_group_id"), F.col("measurement_id")
    frame = m.select(
        s.alias("source_id"), i.alias("line"), F.when((s % 7 == 1) & (i % 97 == 0), " ").otherwise(F.col("solid_name")).alias("solid_name"), "solid_family", (F.col("surface_group_id") % 100).cast("string").alias("solid_substrate"),
        F.when(F.col("liquid_id") == 2, " Methylene  Iodide").otherwise(F.upper("liquid_name")).alias("liquid_name"),
        F.when((s % 7 == 2) & (i % 89 == 0), "n/a").when((s % 7 == 3) & (i % 83 == 0), "181.5").otherwise(F.col("angle").cast("string")).alias("contact_angle_deg"),
        F.col("gamma").alias("liquid_total_surface_tension_mN_m"), F.col("gd").alias("liquid_dispersion_mN_m"), F.when((s % 7 == 4) & (i % 79 == 0), -1.0).otherwise(F.col("gp")).alias("liquid_polar_mN_m"),
        F.when((s % 7 == 5) & (i % 73 == 0), F.concat(F.lit("tilt "), (i % 3).cast("string"))).otherwise("Static").alias("contact_angle_type"), F.lit("sessile_drop").alias("measurement_method"), F.when(i % 2 == 0, "10.9/own").alias("reference_doi"),
    )
    k = F.col("s_suppkey")
    registry = table(spark, sf_dir, "supplier").select(k.alias("source_id"), F.when(k % 11 != 0, F.concat(F.lit("10.1/"), k.cast("string"))).alias("doi"), F.when(k % 22 != 0, F.concat(F.lit("https://e.org/"), k.cast("string"))).alias("url"), F.when(k % 5 == 0, "to_verify").otherwise(" Verified").alias("verification_status"))
    return frame, registry


def import_validation(spark, sf_dir):
    """[Q4 O5] The report of contributed tables: errors of nine rules, warnings, counts and status of each source."""
    return imports.validate(*_contributed(spark, sf_dir))[1]


def import_staged(spark, sf_dir):
    """[Q4 P4 P5 P33] The staged rows: canonical liquids, defaults of the registry, keys and the status of their source."""
    staged = imports.stage(*_contributed(spark, sf_dir))
    return staged.select("line", "source_group_id", "liquid_name", "contact_angle_deg", "reference_doi", "reference_url", "license_verified", "surface_group_id", "liquid_id", "source_row_id", "split", "import_status")


_OWN = "table_grid_rows table_grid_report import_validation import_staged"
QUERIES = {k: globals()[k] for k in _OWN.split()}

_G = """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i FROM lineitem),
p AS (SELECT a.l_orderkey AS doc_id, a.i + 1 AS row, 'P' || b.l_partkey AS label, a.l_partkey, a.l_quantity::INT AS q, a.l_linenumber AS n FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND b.i = a.i - (a.i - 1) % 2),
x AS (SELECT doc_id, 't2' AS table_id, row::INT AS row, label, 'water' AS liquid, CASE WHEN l_partkey % 7 = 0 THEN 'cells' ELSE 'kept' END AS reason, q AS v, n AS d FROM p
  UNION ALL SELECT doc_id, 't2', row, label, 'formamide', CASE WHEN l_partkey % 7 = 0 THEN 'cells' WHEN l_partkey % 5 = 4 THEN 'unparsed' ELSE 'kept' END, q * 2, n FROM p)
"""
_F = SQL + r""", f AS (SELECT source_group_id AS s, measurement_id AS i, trim(CASE WHEN source_group_id % 7 = 1 AND measurement_id % 97 = 0 THEN '' ELSE solid_name END) AS solid_name, solid_family, surface_group_id % 100 AS sub, liquid_name,
  CASE WHEN source_group_id % 7 = 2 AND measurement_id % 89 = 0 THEN NULL WHEN source_group_id % 7 = 3 AND measurement_id % 83 = 0 THEN 181.5::DOUBLE ELSE angle END AS angle,
  CASE WHEN source_group_id % 7 = 4 AND measurement_id % 79 = 0 THEN -1.0::DOUBLE ELSE gp END AS gp, CASE WHEN source_group_id % 7 = 5 AND measurement_id % 73 = 0 THEN 'tilt ' || measurement_id % 3 ELSE 'static' END AS kind FROM m),
b AS (SELECT s, i, unnest([CASE WHEN solid_name = '' THEN 'missing_values:solid_name' END, CASE WHEN angle IS NULL THEN 'non_numeric_or_missing:contact_angle_deg' END, CASE WHEN angle IS NULL OR angle > 180 THEN 'angle_out_of_range' END,
  CASE WHEN gp < 0 THEN 'negative_liquid_property:liquid_polar_mN_m' END, CASE WHEN kind <> 'static' THEN 'unsupported_angle_type' END]) AS rule, kind FROM f),
e AS (SELECT s, rule, count(*) AS n, CASE WHEN rule = 'unsupported_angle_type' THEN array_to_string(list_sort(list_distinct(list(kind)))[1:20], ',') ELSE array_to_string(list_sort(list(i))[1:20], ',') END AS detail FROM b WHERE rule IS NOT NULL GROUP BY s, rule
  UNION ALL SELECT s, 'registry_license_or_access_not_verified', 1, '' FROM (SELECT DISTINCT s FROM f) WHERE s % 5 = 0 UNION ALL SELECT s, 'registry_has_no_doi_or_url', 1, '' FROM (SELECT DISTINCT s FROM f) WHERE s % 22 = 0),
g AS (SELECT s, solid_name, solid_family, sub, liquid_name, kind, count(*) AS n FROM f GROUP BY ALL), u AS (SELECT s, sum(n) AS n, sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS r, count(DISTINCT liquid_name) AS l FROM g GROUP BY s, solid_name, solid_family, sub),
k AS (SELECT s, sum(n)::BIGINT AS n_rows, count(*) AS n_surfaces, (SELECT count(DISTINCT liquid_name) FROM g WHERE g.s = u.s) AS n_liquids, count(*) FILTER (WHERE l >= 3) AS n_feasible_surfaces, sum(r)::BIGINT AS duplicate_key_rows FROM u GROUP BY s),
z AS (SELECT s, CASE WHEN s IN (SELECT s FROM e) THEN 'fail' ELSE 'pass' END AS status FROM k)
"""
_ID = "'{0}_' || upper(substr(sha256({1}), 1, {2}))"
_TOKEN = "lower(trim(regexp_replace(coalesce({}::VARCHAR, ''), '\\s+', ' ', 'g')))"
ORACLES = {
    "table_grid_rows": _G + "SELECT doc_id, table_id, row, label, liquid, CASE WHEN reason = 'kept' THEN v::DOUBLE END AS value, CASE WHEN reason = 'kept' THEN d::DOUBLE END AS deviation, reason, 'static' AS angle_type FROM x",
    "table_grid_report": _G + ", c AS (SELECT doc_id, reason, count(*) AS n FROM x WHERE reason <> 'kept' GROUP BY ALL), s AS (SELECT doc_id, string_agg(reason || '=' || n, ';' ORDER BY reason) AS skipped FROM c GROUP BY 1) "
        "SELECT doc_id, count(*) FILTER (WHERE reason = 'kept') AS n_rows, count(DISTINCT CASE WHEN reason = 'kept' THEN label END) AS n_labels, count(DISTINCT CASE WHEN reason = 'kept' THEN liquid END) AS n_liquids, coalesce(any_value(skipped), '') AS skipped FROM x LEFT JOIN s USING (doc_id) GROUP BY 1",
    "import_validation": _F + """SELECT s AS source_id, 'error' AS kind, rule, n, detail FROM e UNION ALL SELECT s, 'warning', 'duplicate_surface_liquid_angle_type_rows', duplicate_key_rows, '' FROM k WHERE duplicate_key_rows > 0
UNION ALL SELECT s, 'count', rule, n, '' FROM k, LATERAL (VALUES ('n_rows', n_rows), ('n_surfaces', n_surfaces), ('n_liquids', n_liquids), ('n_feasible_surfaces', n_feasible_surfaces), ('duplicate_key_rows', duplicate_key_rows)) v(rule, n) UNION ALL SELECT s, 'status', status, 1, '' FROM z""",
    "import_staged": _F + f"""SELECT i AS line, s::VARCHAR AS source_group_id, liquid_name, angle AS contact_angle_deg, CASE WHEN i % 2 = 0 THEN '10.9/own' WHEN s % 11 <> 0 THEN '10.1/' || s ELSE '' END AS reference_doi, CASE WHEN s % 22 <> 0 THEN 'https://e.org/' || s ELSE '' END AS reference_url,
  CASE WHEN s % 5 = 0 THEN 'no' ELSE 'yes' END AS license_verified, {_ID.format('SFC', " || chr(31) || ".join(_TOKEN.format(x) for x in ('s', 'solid_name', 'solid_family', 'sub')), 12)} AS surface_group_id, {_ID.format('LIQ', _TOKEN.format('liquid_name'), 10)} AS liquid_id,
  {_ID.format('RAW', "s::VARCHAR || chr(31) || i::VARCHAR", 12)} AS source_row_id, 'pending_review' AS split, CASE WHEN status = 'pass' THEN 'validated_staged' ELSE 'rejected' END AS import_status FROM f JOIN z USING (s)""",
}
