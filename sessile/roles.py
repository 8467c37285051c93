"""The star of measurements that the general tables take the roles of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessile.functions.clean import anchored

#: Number, name, total surface tension, dispersion and polar part. Three have no polar part, so singular fits occur.
LIQUIDS = (
    (1, "water", 72.8, 21.8, 51.0),
    (2, "diiodomethane", 50.8, 50.8, 0.0),
    (3, "formamide", 58.0, 39.0, 19.0),
    (4, "glycerol", 64.0, 34.0, 30.0),
    (5, "ethylene glycol", 48.0, 29.0, 19.0),
    (6, "bromonaphthalene", 44.4, 44.4, 0.0),
    (7, "hexadecane", 27.5, 27.5, 0.0),
)
SPLITS = ("train", "validation", "internal_test", "legacy_external", "prospective_open_external")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def liquids(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LIQUIDS, "liquid_id int, liquid_name string, gamma double, gd double, gp double")


def measurements(spark: SparkSession, sf_dir: str, with_id: bool = True) -> DataFrame:
    """One row per line item: a measured angle on a surface with a liquid, two predictions and their uncertainty.

    The id numbers the items of an order line in the order of all their columns; it
    costs a shuffle, so queries that do not need it leave it out.
    """
    line = table(spark, sf_dir, "lineitem")
    if with_id:
        order = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
        rn = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*order))
        line = line.withColumn("measurement_id", F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + rn)
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type", "p_name")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    angle = 3.6 * F.col("l_quantity")
    joined = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.join(F.broadcast(liquids(spark)), F.col("l_linenumber") == F.col("liquid_id")).select(
        *(["measurement_id"] if with_id else []),
        F.col("l_suppkey").alias("source_group_id"),
        (F.col("l_suppkey") * 100 + F.col("p_size")).alias("surface_group_id"),
        "liquid_id",
        "liquid_name",
        "gamma",
        "gd",
        "gp",
        angle.alias("angle"),
        F.when(F.col("l_returnflag") != "R", "yes").otherwise("no").alias("target_eligible"),
        F.element_at(F.array(*map(F.lit, SPLITS)), F.col("s_nationkey") % 5 + 1).alias("v4_split"),
        F.col("p_type").alias("solid_family"),
        F.col("p_name").alias("solid_name"),
        anchored(angle, 400 * (F.col("l_discount") - 0.05)).alias("pred_a"),
        anchored(angle, 500 * (F.col("l_tax") - 0.04)).alias("pred_b"),
        (1 + 100 * F.col("l_discount")).alias("score"),
        "l_orderkey",
        "l_shipdate",
    )


#: The same in DuckDB; "m" has the measurements.
SQL = """
WITH liq(liquid_id, liquid_name, gamma, gd, gp) AS (VALUES
  (1, 'water', 72.8::DOUBLE, 21.8::DOUBLE, 51.0::DOUBLE), (2, 'diiodomethane', 50.8, 50.8, 0.0), (3, 'formamide', 58.0, 39.0, 19.0), (4, 'glycerol', 64.0, 34.0, 30.0),
  (5, 'ethylene glycol', 48.0, 29.0, 19.0), (6, 'bromonaphthalene', 44.4, 44.4, 0.0), (7, 'hexadecane', 27.5, 27.5, 0.0)),
m AS (
  SELECT l_orderkey * 1000 + l_linenumber * 100 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber
           ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS measurement_id,
         l_suppkey AS source_group_id, l_suppkey * 100 + p_size AS surface_group_id, liquid_id, liquid_name, gamma, gd, gp,
         3.6::DOUBLE * l_quantity AS angle, CASE WHEN l_returnflag <> 'R' THEN 'yes' ELSE 'no' END AS target_eligible,
         CASE s_nationkey % 5 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' WHEN 2 THEN 'internal_test' WHEN 3 THEN 'legacy_external' ELSE 'prospective_open_external' END AS v4_split,
         p_type AS solid_family, p_name AS solid_name,
         least(greatest(3.6::DOUBLE * l_quantity + 400::DOUBLE * (l_discount - 0.05::DOUBLE), 0), 180) AS pred_a,
         least(greatest(3.6::DOUBLE * l_quantity + 500::DOUBLE * (l_tax - 0.04::DOUBLE), 0), 180) AS pred_b,
         1 + 100::DOUBLE * l_discount AS score, l_orderkey, l_shipdate
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN liq ON l_linenumber = liquid_id)
"""
