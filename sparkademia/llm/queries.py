"""Queries of the training-data problems and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkademia.llm import canonical, leakage, mixing, mojibake, seen, survivor
from sparkademia.session import table


def p2_survivors(spark: SparkSession, d: str) -> DataFrame:
    """The surviving row and the best value of each field for every programme."""
    return survivor.survivors(table(spark, d, "degree_programs"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.clear_survivors(table(spark, d, "degree_programs"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return seen.seen_before(table(spark, d, "crawl_queue_state"), ["domain", "url"], "id")


def p3_error_rate(spark: SparkSession, d: str) -> DataFrame:
    """How often the answers of p3_found are wrong."""
    return seen.error_report(table(spark, d, "crawl_queue_state"), ["domain", "url"], "id")


def p6_programmes(spark: SparkSession, d: str) -> DataFrame:
    """One row per programme with its number of copies."""
    return canonical.collapse(table(spark, d, "degree_programs"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.copies_of(table(spark, d, "degree_programs"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """How many documents each test item leaked into."""
    return leakage.leak_report(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mixture, as large as the targets' documents: every use of a document with its shard and place."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), total="corpus")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares of tokens that the mixture reaches."""
    return mixing.shares(p9_mix(spark, d), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled_documents(table(spark, d, "documents"))


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """The affected documents with their text restored where possible."""
    return mojibake.restored_documents(table(spark, d, "documents"))


def queries() -> dict:
    found = (p2_found, p3_found, p6_found, p8_found, p9_mix, p10_found)
    return {f.__name__: f for f in (*found, p2_survivors, p3_error_rate, p6_programmes, p8_items, p9_shares, p10_restored)}


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": """
            SELECT id FROM (SELECT id, min(id) OVER (PARTITION BY domain, url) AS first FROM crawl_queue_state)
            WHERE id > first""",
        "p3_error_rate": """
            WITH k AS (SELECT count(*) AS n FROM crawl_queue_state GROUP BY domain, url),
                 t AS (SELECT sum(n)::BIGINT AS total_rows, count(*) AS distinct_keys FROM k)
            SELECT total_rows, distinct_keys, total_rows - distinct_keys AS called_seen, 0::BIGINT AS wrong_answers,
                   0.0::DOUBLE AS wrong_rate, distinct_keys::DOUBLE * distinct_keys / power(2.0, 65) AS expected_wrong
            FROM t""",
    }
