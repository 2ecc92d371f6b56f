"""Other tables as events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.schema import COLUMNS


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream table: ids from 1, the type as service and level, users spread over hosts and sources."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    level = F.when(F.col("event_type") == "error", 50).when(F.col("event_type") == "purchase", 40).when(F.col("event_type") == "signup", 30).when(F.col("event_type") == "click", 20).otherwise(10)
    time = F.expr("unix_micros(cast(ts as timestamp)) div 1000L")
    return e.select(
        (F.col("event_id") + 1).alias("id"), F.concat(F.lit("src-"), (F.col("user_id") % 3).cast("string")).alias("source"), time.alias("event_time"), time.alias("received_at"), level.alias("level"),
        F.col("event_type").alias("service"), F.lit(None).cast("string").alias("logger"), F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("host"), F.col("user_id").alias("pid"),
        F.concat_ws(" ", F.col("event_type"), F.lit("by user"), F.col("user_id").cast("string")).alias("message"), F.coalesce("props", F.lit("{}")).alias("attributes"),
    ).select(*COLUMNS)


#: The same view for the SQL of the tests.
EVENTS_SQL = """e AS (
  SELECT event_id + 1 AS id, 'src-' || (user_id % 3) AS source, epoch_us(ts) // 1000 AS event_time, epoch_us(ts) // 1000 AS received_at,
         CASE event_type WHEN 'error' THEN 50 WHEN 'purchase' THEN 40 WHEN 'signup' THEN 30 WHEN 'click' THEN 20 ELSE 10 END AS level,
         event_type AS service, CAST(NULL AS VARCHAR) AS logger, 'u' || (user_id % 7) AS host, user_id AS pid,
         concat_ws(' ', event_type, 'by user', CAST(user_id AS VARCHAR)) AS message, coalesce(CAST(props AS VARCHAR), '{}') AS attributes
  FROM events)"""


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    t = (F.col("conv_id") * 1000 + F.col("turn")).cast("bigint")
    return c.select(
        (t + 1).alias("id"), F.concat(F.lit("conv-"), (F.col("conv_id") % 5).cast("string")).alias("source"), t.alias("event_time"), t.alias("received_at"), F.col("turn").cast("int").alias("level"),
        F.lit("chat").alias("service"), F.col("role").alias("logger"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("bigint").alias("pid"), F.coalesce("text", F.lit("")).alias("message"), F.lit("{}").alias("attributes"),
    )


CONVERSATIONS_SQL = """e AS (
  SELECT conv_id * 1000 + turn + 1 AS id, 'conv-' || (conv_id % 5) AS source, conv_id * 1000 + turn AS event_time, conv_id * 1000 + turn AS received_at, CAST(turn AS INTEGER) AS level,
         'chat' AS service, role AS logger, CAST(NULL AS VARCHAR) AS host, CAST(NULL AS BIGINT) AS pid, coalesce(text, '') AS message, '{}' AS attributes
  FROM conversations)"""
