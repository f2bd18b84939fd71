"""The ``events`` table as turns: a user is a session, signups are prompts, errors are failed results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def event_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    prompt, error = F.col("event_type") == "signup", F.col("event_type") == "error"
    return e.select(
        F.col("user_id").alias("session"),
        F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("idx"),
        F.when(prompt, "user").when(error, "tool").otherwise("assistant").alias("actor"),
        F.when(prompt, "message").when(error, "tool_result").otherwise("tool_call").alias("kind"),
        F.col("ts").alias("at"),
        F.when(prompt, F.when(F.col("event_id") % 3 == 0, "yes, go on").when(F.col("event_id") % 3 == 1, "never do that").otherwise("start over with the report")).alias("text"),
        F.when(~prompt & ~error, F.col("event_type")).alias("tool"),
        F.lit(None).cast("string").alias("command"),
        error.alias("is_error"),
    )
