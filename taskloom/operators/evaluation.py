"""How well findings foretell what people wrote down later, each judged by what was known at its time.

Groups that form in the order of time are, as of a date, their members before
it: no row's choice depends on a later one. So one grouping serves all dates,
and what a group was at a date (its runs, its vocabulary, its rank) comes from
prefix sums, not from mining anew for every truth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..written import written
from .leaders import sums_before


def rows_before(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """cutoffs (cutoff) with ``at``: how many rows (start) are undated or begin before it; all of them for a null cutoff."""
    times = rows.where("start is not null").groupBy(F.col("start").alias("t")).agg(F.count("*").alias("n")).union(cutoffs.select("cutoff", F.lit(0)).where("cutoff is not null").distinct())
    times = times.groupBy("t").agg(F.sum("n").alias("n")).withColumn("day", F.to_date("t"))
    within = times.select("t", "day", (F.sum("n").over(Window.partitionBy("day").orderBy("t")) - F.col("n")).alias("today"))
    days = times.groupBy("day").agg(F.sum("n").alias("n")).select("day", (F.sum("n").over(Window.orderBy("day")) - F.col("n")).alias("earlier"))  # a row a day
    dated = within.join(days, "day").select(F.col("t").alias("cutoff"), (F.col("today") + F.col("earlier")).alias("dated"))
    undated, all_ = rows.agg(F.count_if(F.col("start").isNull()), F.count("*")).first()
    return cutoffs.join(dated, "cutoff", "left").withColumn("at", F.when(F.col("cutoff").isNull(), F.lit(all_)).otherwise(F.coalesce("dated", F.lit(0)) + undated)).drop("dated")


def ranks_as_of(truths: DataFrame, rows: DataFrame, groups: DataFrame, words: DataFrame, least: float = 0.45, min_share: float = 0.34, min_runs: int = 3) -> DataFrame:
    """(truth_id, rank, similarity) of each truth (truth_id, cutoff, tokens): the best-ranked group that foretold it; null rank for none.

    ``rows`` (n, start) are numbered in the order of start, undated ones first;
    ``groups`` (n, leader) come from a pass in that order; ``words`` are (n,
    token). As of the cutoff a group has the rows before it, ``min_runs`` at
    least, and the tokens that ``min_share`` of them hold; it matches where the
    truth has ``least`` of these. Groups rank by their number of rows, and share
    a rank where that is equal; the more similar one is told then.
    """
    placed = written(_placed(truths, rows))
    one = F.lit(1.0)
    each = written(words.select("n", "token").distinct().join(groups, "n").select("leader", "token", "n"))
    seen = each.groupBy("leader", "token").agg(F.min("n").alias("since"))
    wanted = placed.select("truth_id", "at", F.explode("tokens").alias("token"))
    pairs = wanted.join(seen, "token").where(F.col("since") < F.col("at")).select("truth_id", "at", "leader").distinct()
    runs = sums_before(groups.select("leader", "n", one.alias("value")), pairs.select("leader", F.col("at").alias("n")).distinct(), ["leader"]).select("leader", F.col("n").alias("at"), F.col("value").cast("long").alias("runs")).where(F.col("runs") >= min_runs)
    alive = written(runs)  # (leader, at, runs) of the groups and dates that some truth asks for
    asks = alive.join(seen, "leader").where(F.col("since") < F.col("at")).select("leader", "token", F.col("at").alias("n"))
    held = sums_before(each.select("leader", "token", "n", one.alias("value")), asks, ["leader", "token"]).withColumnRenamed("n", "at")
    vocabulary = written(held.join(alive, ["leader", "at"]).where(F.col("value") / F.col("runs") >= min_share).select("leader", "at", "token"))
    sizes = vocabulary.groupBy("leader", "at").agg(F.count("*").alias("size"))
    common = wanted.join(vocabulary, ["token", "at"]).groupBy("truth_id", "at", "leader").agg(F.count("*").alias("common"))
    fit = common.join(sizes, ["leader", "at"]).withColumn("similarity", F.col("common") / F.col("size")).where(F.col("similarity") >= least).join(alive, ["leader", "at"])
    # A group outranks those of r rows once it has r + 1: each reaches that number once.
    reached = groups.select(F.row_number().over(Window.partitionBy("leader").orderBy("n")).cast("long").alias("many"), "n", one.alias("value"))
    above = sums_before(reached, fit.select((F.col("runs") + 1).alias("many"), F.col("at").alias("n")).distinct(), ["many"]).select((F.col("many") - 1).alias("runs"), F.col("n").alias("at"), (F.col("value") + 1).cast("long").alias("rank"))
    best = fit.join(above, ["runs", "at"]).groupBy("truth_id").agg(F.min(F.struct("rank", (-F.col("similarity")).alias("less"))).alias("best"))
    return truths.select("truth_id").join(best.select("truth_id", F.col("best.rank").alias("rank"), (-F.col("best.less")).alias("similarity")), "truth_id", "left")


def _placed(truths: DataFrame, rows: DataFrame) -> DataFrame:
    """truths with ``at``, the number of rows before their cutoff."""
    places = rows_before(rows, truths.select("cutoff").distinct()).withColumnRenamed("cutoff", "c")
    return truths.select("truth_id", "cutoff", F.array_distinct("tokens").alias("tokens")).join(places, F.col("cutoff").eqNullSafe(F.col("c"))).drop("c")
