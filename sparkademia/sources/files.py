"""Readers of page records, access logs, resource samples, gate rows, robots and sitemap files."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkademia import schemas
from sparkademia.operators.accesslog import Run


def _ordinal(df: DataFrame) -> DataFrame:
    """Each row's place: by file, then by line within it."""
    return df.withColumn("ordinal", F.monotonically_increasing_id())


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = schemas.PAGE_RECORD) -> DataFrame:
    """Page records, one a line, with their `ordinal`. Blank lines are skipped; lines that aren't JSON are dropped."""
    bad = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(bad).option("mode", "PERMISSIVE").json(path)
    keep = F.col("_corrupt_record").isNull()
    return _ordinal(rows.where(keep).drop("_corrupt_record"))


def read_json_array(spark: SparkSession, path: str, schema: T.StructType = schemas.PAGE_RECORD) -> DataFrame:
    """A file with one object or an array of them."""
    return _ordinal(spark.read.schema(schema).option("multiLine", True).json(path))


def latest(spark: SparkSession, pattern: str) -> str:
    """The last path in lexical order that matches a pattern."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    names = sorted(f.getPath().toString() for f in (found or []))
    if not names:
        raise FileNotFoundError(pattern)
    return names[-1]


def write_jsonl(records: DataFrame, path: str) -> None:
    """Page records, one a line, with domain and number of degrees; missing degree lists are empty."""
    none = F.array().cast(records.schema["degrees"].dataType)
    host = F.lower(F.regexp_extract("url", "^[^/]*//([^/?#]*)", 1))
    out = records.withColumn("degrees", F.coalesce("degrees", none)).withColumn("domain", host).withColumn("degree_count", F.size("degrees").cast("long"))
    out.drop("ordinal").write.mode("overwrite").json(path)


def read_gate_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows for the quality gate from CSV: quoted fields may hold line breaks; a byte order mark is taken off."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = [c.lstrip("﻿").strip() for c in rows.columns]
    rows = rows.toDF(*names)
    return rows.select(*[(F.col(f.name) if f.name in names else F.lit(None).cast("string")).alias(f.name) for f in schemas.GATE_ROW])


def read_gate_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.GATE_ROW).option("multiLine", True).json(path)


def latest_run(rows: DataFrame, run: int | None = None) -> DataFrame:
    """The rows of one run, by default the one with the highest number."""
    return rows.where(F.col("run_id") == (F.lit(run) if run is not None else rows.agg(F.max("run_id")).scalar()))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def read_run(spark: SparkSession, folder: str) -> Run:
    """A run's access.jsonl, domains.csv, pages.csv and, if there is one, workers.csv. Without send_ts a request ended when
    it began; without an outcome it was sent; the label is the log's, else the folder's name."""
    folder = folder.rstrip("/")
    log = _ordinal(spark.read.schema(schemas.ACCESS).json(f"{folder}/access.jsonl"))
    log = log.select(
        "host", "path", "recv_ts", F.coalesce("send_ts", "recv_ts").alias("send_ts"), "status", "response_type", F.coalesce("injected_delay_ms", F.lit(0)).alias("injected_delay_ms"),
        F.coalesce("outcome", F.lit("sent")).alias("outcome"), "client_ip", F.coalesce("run_label", F.lit(folder.rsplit("/", 1)[-1])).alias("run_label"), F.col("ordinal").alias("line"),
    )
    csv = lambda name, schema: spark.read.schema(schema).option("header", True).csv(f"{folder}/{name}.csv")
    workers = csv("workers", schemas.WORKERS) if _exists(spark, f"{folder}/workers.csv") else spark.createDataFrame([], schemas.WORKERS)
    return Run(log, csv("domains", schemas.DOMAINS), csv("pages", schemas.PAGES), workers)


def read_resources(spark: SparkSession, folder: str) -> DataFrame:
    """Resource samples of a run: one source per CSV file under resources."""
    path = f"{folder.rstrip('/')}/resources"
    if not _exists(spark, path):
        return spark.createDataFrame([], T.StructType([*schemas.RESOURCES.fields, T.StructField("at", T.TimestampType()), T.StructField("source", T.StringType())]))
    rows = spark.read.schema(schemas.RESOURCES).option("header", True).csv(f"{path}/*.csv")
    return rows.withColumn("at", F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd HH:mm:ss"))).withColumn("source", F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", ""))


# --- robots and sitemaps ------------------------------------------------------------------------------------------------


def sitemap_directives(robots: str | None) -> list[str]:
    lines = (x.strip() for x in (robots or "").splitlines())
    return [v for v in (x.split(":", 1)[1].strip() for x in lines if x.lower().startswith("sitemap:")) if v]


def sitemap_urls(xml: str | None) -> tuple[list[str], list[str]]:
    """(pages, nested sitemaps) of a sitemap file; nothing of what can't be parsed."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return [], []
    space, _, name = root.tag.rpartition("}")
    space = space + "}" if space else ""
    item = {"urlset": "url", "sitemapindex": "sitemap"}.get(name)
    found = [e.text.strip() for x in root.findall(f"{space}{item}") if (e := x.find(f"{space}loc")) is not None and e.text] if item else []
    return (found, []) if name == "urlset" else ([], found)


_SITEMAP = T.StructType([T.StructField("pages", T.ArrayType(T.StringType())), T.StructField("nested", T.ArrayType(T.StringType()))])


@F.pandas_udf(T.ArrayType(T.StringType()))
def robots_sitemaps(robots: pd.Series) -> pd.Series:
    return robots.map(sitemap_directives)


@F.pandas_udf(_SITEMAP)
def parse_sitemap(xml: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([sitemap_urls(x) for x in xml], columns=["pages", "nested"])


def can_fetch(agent: str = "*"):
    """UDF (robots text, url) -> whether the robots file lets the agent fetch it; without a file all may be fetched."""

    @F.pandas_udf(T.BooleanType())
    def run(robots: pd.Series, url: pd.Series) -> pd.Series:
        parsed: dict[str, RobotFileParser] = {}
        out = []
        for text, u in zip(robots, url):
            if text is None:
                out.append(True)
                continue
            if text not in parsed:
                p = RobotFileParser()
                p.parse(text.splitlines())
                parsed[text] = p
            out.append(parsed[text].can_fetch(agent, u or ""))
        return pd.Series(out, dtype=bool)

    return run


# --- reports ----------------------------------------------------------------------------------------------------------


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A small result as a Markdown table."""
    cell = lambda v: "-" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    rows = ["| " + " | ".join(df.columns) + " |", "|" + "|".join(" --- " for _ in df.columns) + "|"]
    return "\n".join(rows + ["| " + " | ".join(map(cell, r)) + " |" for r in df.limit(limit).collect()])


def write_run_report(metrics: DataFrame, delays: DataFrame, folder: str) -> None:
    """summary as JSON and the delay table as CSV."""
    metrics.write.mode("overwrite").json(f"{folder}/summary")
    delays.write.mode("overwrite").option("header", True).csv(f"{folder}/crawl_delay")
