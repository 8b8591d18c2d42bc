"""Question-shaped tables derived from the plain ones, by the same rules in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each part: id, question, options, answer, difficulty, source, position."""
    p = table(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    return p.select(
        key.alias("id"),
        F.concat(F.lit("Cau "), key.cast("string"), F.lit(". "), F.col("p_name")).alias("question"),
        F.array(F.concat(F.lit("A. "), "p_brand"), F.concat(F.lit("B. "), "p_type"), F.concat(F.lit("C. Size "), size.cast("string")), F.concat(F.lit("D. "), "p_name")).alias("options"),
        F.substring(F.lit("ABCD"), (key % 4 + 1).cast("int"), F.lit(1)).alias("answer"),
        F.when(size % 4 == 0, "Easy").when(size % 4 == 1, "Medium").when(size % 4 == 2, "Hard").otherwise("").alias("difficulty"),
        F.col("p_brand").alias("source"),
        key.alias("position"),
    )


RECORDS = """
records AS (
  SELECT p_partkey AS id, 'Cau ' || p_partkey || '. ' || p_name AS question,
         ['A. ' || p_brand, 'B. ' || p_type, 'C. Size ' || p_size, 'D. ' || p_name] AS options,
         substr('ABCD', CAST(p_partkey % 4 + 1 AS INT), 1) AS answer,
         CASE p_size % 4 WHEN 0 THEN 'Easy' WHEN 1 THEN 'Medium' WHEN 2 THEN 'Hard' ELSE '' END AS difficulty,
         p_brand AS source, p_partkey AS position
  FROM part)"""


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each document: its first line as the question, words of its text as options."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    w = F.split("text", r"\s+")
    options = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.concat(F.substring(F.lit("ABCD"), i + 1, F.lit(1)), F.lit(". "), F.coalesce(F.get(w, i * 2 + 1), F.lit("")), F.lit(" "), F.coalesce(F.get(w, i * 2 + 2), F.lit(""))))
    return d.select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("question"), options.alias("options"), F.lit("A").alias("answer"), F.col("source"), F.col("doc_id").alias("position"))


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One error for each event: message and status by its type."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id") % 9
    messages = ["429 Too Many Requests", "Quota exceeded: daily limit", "503 Service Unavailable", "Unexpected token in JSON", "empty response", "API key not valid", "request too large", "permission denied", "something else"]
    status = [429, 0, 503, 0, 0, 400, 413, 403, 0]
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (n + 1).cast("int"))
    return e.select("event_id", "ts", "user_id", "event_type", pick(messages).alias("message"), pick(status).alias("status"), (F.col("event_id") % 4 + 1).cast("int").alias("attempts"), (F.col("event_id") % 5 * 100).alias("delay_hint"))


FAILURES = """
failures AS (
  SELECT event_id, ts, user_id, event_type,
         list_extract(['429 Too Many Requests', 'Quota exceeded: daily limit', '503 Service Unavailable', 'Unexpected token in JSON', 'empty response',
                       'API key not valid', 'request too large', 'permission denied', 'something else'], CAST(event_id % 9 + 1 AS INT)) AS message,
         list_extract([429, 0, 503, 0, 0, 400, 413, 403, 0], CAST(event_id % 9 + 1 AS INT)) AS status,
         CAST(event_id % 4 + 1 AS INT) AS attempts, event_id % 5 * 100 AS delay_hint
  FROM events)"""
