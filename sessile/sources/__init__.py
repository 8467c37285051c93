"""Readers and writers."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: A side of a join is broadcast only if it has at most so many rows, counted.
BROADCAST_ROWS = 100_000


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """[S1 S2] A table by its suffix; CSV with a header, blank lines dropped and the byte order mark ignored."""
    name = path.rstrip("/").lower()
    if name.endswith((".csv", ".csv.gz")):
        reader = spark.read.option("header", True).option("encoding", "UTF-8").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
        frame = (reader.schema(schema) if schema else reader).csv(path)
        return frame.withColumnsRenamed({c: c.strip("﻿ ") for c in frame.columns}).na.drop("all")
    if name.endswith(".parquet"):
        return spark.read.parquet(path)
    if name.endswith((".json", ".jsonl")):
        return (spark.read.schema(schema) if schema else spark.read).json(path)
    raise ValueError(f"unknown kind of table: {path}")


def read_many(frames: Sequence[DataFrame], aliases: Mapping[str, str], required: Sequence[str]) -> DataFrame:
    """[S3 U1] Union of tables whose headers vary: aliases are renamed, required columns checked, others filled with null."""
    out: DataFrame | None = None
    for f in frames:
        f = f.withColumnsRenamed({k: v for k, v in aliases.items() if k in f.columns})
        if missing := [c for c in required if c not in f.columns]:
            raise ValueError(f"columns are missing: {missing}")
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    if out is None:
        raise ValueError("no tables")
    return out


def require_key(frame: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """[S4] Rows with the registry's columns; a key that the registry lacks stops the query when it runs."""
    known = registry.withColumn("_known", F.lit(True))
    joined = frame.join(known, key, "left")
    check = F.assert_true(F.coalesce("_known", F.lit(False)), F.concat(F.lit(f"unknown {key}: "), F.col(key).cast("string")))
    return joined.withColumn("_ok", check).filter(F.col("_ok").isNull()).drop("_known", "_ok")


def write_table(frame: DataFrame, path: str, columns: Sequence[str], overwrite: bool = False) -> None:
    """[S6 Q17] Columns in a fixed order, as CSV or Parquet by suffix; an existing table is kept unless told otherwise."""
    writer = frame.select(*columns).write.mode("overwrite" if overwrite else "errorifexists")
    writer.option("header", True).csv(path) if path.endswith(".csv") else writer.parquet(path)


def write_report(frame: DataFrame, path: str) -> None:
    """[S7] Rows of a report as JSON lines."""
    frame.write.mode("overwrite").json(path)


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """[S8] Name, SHA-256 and size of files."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("sha256"), F.length("content").alias("bytes"))


def fingerprint(columns: Sequence[str]) -> Column:
    """[S8 S9] An aggregate that tells tables apart whatever the order of rows: the sum of a hash of each."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    return F.sum(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"))


def read_glob(spark: SparkSession, pattern: str, aliases: Mapping[str, str], required: Sequence[str]) -> DataFrame:
    """[S3 U1] All CSV files of a pattern whose headers vary, as text, with the file's name and each row's ordinal in it.

    The first line of each file is read as text, in Spark; files with one header are
    read together, so that there are as many reads as headers. Aliases are renamed
    (the column itself stands if a file has both), required columns are checked, and
    the first file without one is named; other columns are filled with null. Rows whose cells are all
    blank are left out. Files are not split, so that a row's place in its file is known.
    """
    lines = spark.read.option("wholetext", False).text(pattern).select(F.input_file_name().alias("path"), F.input_file_block_start().alias("at"), F.monotonically_increasing_id().alias("id"), "value")
    heads = lines.filter(F.col("at") == 0).groupBy("path").agg(F.min_by("value", "id").alias("head"))
    kinds = heads.groupBy("head").agg(F.array_sort(F.collect_list("path")).alias("paths")).collect()  # the names of the files, by header
    out: DataFrame | None = None
    for kind in sorted(kinds, key=lambda r: r["paths"][0]):
        names = [c.strip("﻿ \r\"") for c in next(csv.reader([kind["head"].strip("﻿\r\n")]))]
        known = {c: c if c in names and c not in aliases else aliases.get(c, c) for c in names}
        have = [c for c in names if known[c] == c or known[c] not in names]
        if missing := [c for c in required if c not in {known[c] for c in have}]:
            raise ValueError(f"columns are missing in {kind['paths'][0].rsplit('/', 1)[-1]}: {missing}")
        schema = ", ".join(f"`c{i}` string" for i in range(len(names)))
        frame = spark.read.option("header", True).option("enforceSchema", True).option("multiLine", True).option("encoding", "UTF-8").schema(schema).csv(list(kind["paths"]))
        cells = [F.nullif(F.trim(F.col(f"c{names.index(c)}")), F.lit("")).alias(known[c]) for c in have]
        one = frame.select(*cells, F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("_file"), F.monotonically_increasing_id().alias("_id"))
        one = one.filter(F.coalesce(*[F.col(known[c]) for c in have]).isNotNull())
        one = one.withColumn("_row", F.row_number().over(Window.partitionBy("_file").orderBy("_id"))).drop("_id")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no files: {pattern}")
    return out
