"""Images over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixels


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y: vector, x: position, v: component."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "v")).select("y", F.col("x").cast("long").alias("x"), F.col("v").cast("double").alias("v"))


def embedding_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, -0.6 to 0.6 as one byte."""
    return embedding_image(spark, sf_dir).withColumn("v", (pixels.normalise(F.col("v"), -0.6, 0.6) * 255).cast("int"))


def order_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t: year from 1992, c: flag and status, z: line, y: quantity, x: discount in percent, v: number of rows."""
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    at = {"t": F.year("l_shipdate") - 1992, "c": flag * 2 + F.when(F.col("l_linestatus") == "F", 0).otherwise(1), "z": F.col("l_linenumber") - 1, "y": F.col("l_quantity") - 1, "x": F.rint(F.col("l_discount") * 100)}
    rows = table(spark, sf_dir, "lineitem").select(*[e.cast("long").alias(a) for a, e in at.items()])
    return rows.groupBy(*at).agg(F.count("*").alias("v"))


def event_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t: day, c: type of event, y: hour, x: user, v: sum of values."""
    rows = table(spark, sf_dir, "events").select((F.dayofmonth("ts") - 1).cast("long").alias("t"), F.col("event_type").alias("c"), F.hour("ts").cast("long").alias("y"), F.col("user_id").alias("x"), "value")
    return rows.groupBy("t", "c", "y", "x").agg(F.sum("value").alias("v"))


#: The same views in SQL, to stand before an oracle's query.
E_SQL = "e AS (SELECT vec_id AS y, unnest(generate_series(0, len(embedding) - 1)) AS x, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
E8_SQL = E_SQL + ", e8 AS (SELECT y, x, CAST(trunc(greatest(least((v - -0.6::DOUBLE) / (0.6::DOUBLE - -0.6::DOUBLE), 1.0), 0.0) * 255) AS INTEGER) AS v FROM e)"
L_SQL = """l AS (SELECT CAST(year(l_shipdate) - 1992 AS BIGINT) AS t,
  CAST((CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) * 2 + (CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END) AS BIGINT) AS c,
  CAST(l_linenumber - 1 AS BIGINT) AS z, CAST(l_quantity - 1 AS BIGINT) AS y, CAST(round_even(l_discount * 100, 0) AS BIGINT) AS x, count(*) AS v
  FROM lineitem GROUP BY ALL)"""
V_SQL = "w AS (SELECT CAST(day(ts) - 1 AS BIGINT) AS t, event_type AS c, CAST(hour(ts) AS BIGINT) AS y, user_id AS x, sum(value) AS v FROM events GROUP BY ALL)"
