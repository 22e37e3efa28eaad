"""Stores of related tables: copy, verify, export."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def copy_store(tables: Mapping[str, DataFrame], path: str) -> None:
    """A full refresh: every table overwritten at `path`/name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def verify_store(tables: Mapping[str, DataFrame], spark: SparkSession, path: str) -> DataFrame:
    """(table, original, copied, equal): row counts of a copy against its originals."""
    out: DataFrame | None = None
    for name, df in tables.items():
        a = df.agg(F.count(F.lit(1)).alias("original"))
        row = a.withColumn("copied", spark.read.schema(df.schema).parquet(f"{path}/{name}").agg(F.count(F.lit(1))).scalar()).select(F.lit(name).alias("table"), "original", "copied")
        out = row if out is None else out.unionByName(row)
    if out is None:
        return spark.createDataFrame([], "table string, original long, copied long, equal boolean")
    return out.withColumn("equal", F.col("original") == F.col("copied"))


def export_csv(tables: Mapping[str, DataFrame], path: str) -> None:
    """Every table as CSV with a header; truth values as 0 and 1."""
    for name, df in tables.items():
        cols = [F.col(c).cast("int").alias(c) if t == "boolean" else F.col(c) for c, t in df.dtypes]
        df.select(*cols).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def read_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query's result from a database by JDBC; the driver's jar must be on the class path."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()
