"""Measurement rows from tables in article markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessile.functions.clean import clean_text, clean_value

_PARTS = {"table": r"(?s)<table-wrap\b[^>]*>(.*?)</table-wrap>", "row": r"(?s)<tr\b[^>]*>(.*?)</tr>", "cell": r"(?s)<t[dh]\b[^>]*>(.*?)</t[dh]>"}


def _all(text: Column, part: str) -> Column:
    return F.regexp_extract_all(text, F.lit(_PARTS[part]), F.lit(1))


def plain(markup: Column) -> Column:
    """Text without tags, its white space collapsed."""
    return clean_text(F.regexp_replace(markup, "<[^>]*>", " "))


def extract_tables(docs: DataFrame, spec: DataFrame) -> DataFrame:
    """[S5 S5a S5b] Rows of tables whose caption has a word of the spec, one for each liquid's column.

    docs: doc_id, xml. spec, a small table: caption (a word of it), skip (header rows),
    least (cells of a row), liquid, cell (its column from 0). Returns doc_id, table, row,
    label (the first cell), liquid, value, deviation, reason: null where the value
    stands, else too_few_cells, empty, range, or unparsed. Null documents and those
    without such tables give no rows.
    """
    # A row's cells are cleaned once, whatever the number of columns that are read from it.
    wanted = spec.groupBy("caption", "skip", "least").agg(F.collect_list(F.struct("liquid", "cell")).alias("_wanted"))
    tables = docs.select("doc_id", F.posexplode(_all(F.coalesce("xml", F.lit("")), "table")).alias("table", "_t"))
    tables = tables.withColumn("_caption", F.lower(plain(F.regexp_extract("_t", r"(?s)<caption\b[^>]*>(.*?)</caption>", 1))))
    found = tables.join(F.broadcast(wanted), F.col("_caption").contains(F.lower("caption")))
    rows = found.select("doc_id", "table", "skip", "least", "_wanted", F.posexplode(_all(F.col("_t"), "row")).alias("row", "_r")).filter(F.col("row") >= F.col("skip"))
    rows = rows.select("doc_id", "table", "row", "least", "_wanted", F.transform(_all(F.col("_r"), "cell"), plain).alias("_cells"))
    each = rows.select("doc_id", "table", "row", F.coalesce(F.get("_cells", F.lit(0)), F.lit("")).alias("label"), (F.size("_cells") < F.col("least")).alias("_few"), "_cells", F.inline("_wanted"))
    each = each.select("doc_id", "table", "row", "label", "liquid", "_few", F.coalesce(F.get("_cells", F.col("cell")), F.lit("")).alias("_text"))
    each = each.withColumn("_v", F.when(~F.col("_few") & (F.col("_text") != ""), clean_value(F.col("_text"))))
    reason = F.when(F.col("_few"), "too_few_cells").when(F.col("_text") == "", "empty").when(F.col("_text").rlike(r"^[0-9.]+\s*[-–]\s*[0-9.]+$"), "range").when(F.col("_v.value").isNull(), "unparsed")
    out = each.select("doc_id", "table", "row", "label", "liquid", "_v", reason.alias("reason"))
    kept = F.col("reason").isNull()
    return out.select("doc_id", "table", "row", "label", "liquid", F.when(kept, F.col("_v.value")).alias("value"), F.when(kept, F.col("_v.deviation")).alias("deviation"), "reason")
