"""Idle-separated islands of a stream of turns, with late turns up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def islands(turns: DataFrame, idle: str = "90 minutes", late: str = "1 day") -> DataFrame:
    """(session, start, end, turns, errors): emitted once the watermark has passed an island's end."""
    island = F.session_window("at", idle)
    out = turns.withWatermark("at", late).groupBy("session", island.alias("w")).agg(F.count("*").alias("turns"), F.count_if("is_error").alias("errors"))
    return out.select("session", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "turns", "errors")
