"""What arcs of one group have in common: cadence, steps, keywords, matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clamp, meaningful, round3
from .similar import groups, jaccard_pairs, step_set


def cadence(arcs: DataFrame, by: str = "session") -> DataFrame:
    """Distinct days, spacing and a label per group; gaps are counted between days."""
    days = arcs.where(F.col("start").isNotNull()).select(by, F.to_date("start").alias("day")).distinct()
    gap = F.datediff("day", F.lag("day").over(Window.partitionBy(by).orderBy("day"))) * F.lit(24.0)
    out = days.withColumn("gap", gap).groupBy(by).agg(
        F.min("day").alias("first_seen"), F.max("day").alias("last_seen"), F.count("*").alias("days"),
        F.coalesce(F.percentile("gap", F.lit(0.5)), F.lit(0.0)).alias("median"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("spread"),
    )
    regular = F.when((F.col("days") < 3) | (F.col("mean") <= 0), F.lit(0.0)).otherwise(clamp(1 - F.col("spread") / F.col("mean")))
    out = out.withColumn("median_interval_hours", round3(F.col("median"))).withColumn("regularity", round3(regular))
    label = F.when(F.col("days") < 2, "once").when(F.col("median_interval_hours") <= 0, "same day").when(F.col("regularity") < 0.25, "bursty")
    for most, name in ((30, "about daily"), (96, "every few days"), (200, "roughly weekly"), (800, "every few weeks")):
        label = label.when(F.col("median_interval_hours") <= most, name)
    span = (F.datediff("last_seen", "first_seen") + 1).cast("long")
    return out.select(by, "first_seen", "last_seen", "days", span.alias("span_days"), "median_interval_hours", "regularity", label.otherwise("occasional").alias("label"))


def canonical_steps(arcs: DataFrame, by: str = "session", min_support: float = 0.45) -> DataFrame:
    """(group, rank, action, support, count, position): steps that most arcs of a group have."""
    total = arcs.groupBy(by).agg(F.count("*").alias("arcs"))
    each = arcs.select(by, "arc_id", F.size("steps").alias("n"), F.posexplode("steps").alias("at", "action"))
    first = each.groupBy(by, "arc_id", "action").agg(F.min(F.when(F.col("n") > 1, F.col("at") / (F.col("n") - 1)).otherwise(F.lit(0.0))).alias("at"))
    steps = first.groupBy(by, "action").agg(F.count("*").alias("count"), F.percentile("at", F.lit(0.5)).alias("position")).join(total, by)
    steps = steps.where(F.col("count") / F.col("arcs") >= min_support).withColumn("support", round3(F.col("count") / F.col("arcs"))).withColumn("position", round3(F.col("position")))
    rank = F.row_number().over(Window.partitionBy(by).orderBy("position", F.col("count").desc(), "action"))
    return steps.select(by, rank.cast("long").alias("rank"), "action", "support", "count", "position")


def idf(docs: DataFrame, key: str, words: Column) -> DataFrame:
    """(token, df, idf) with idf = ln((n + 1) / (df + 1)) + 1."""
    n = docs.select(F.count("*").alias("docs"))
    df = docs.select(F.explode(F.array_distinct(words)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n)).select("token", "df", (F.log((F.col("docs") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def tfidf(docs: DataFrame, key: str, words: Column) -> DataFrame:
    """(key, token, weight) with weight = (1 + ln tf) x idf, not normalised; texts are tokenised once, df is counted over the (key, token) rows."""
    tf = docs.select(key, F.explode(words).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))
    n = docs.select(F.count("*").alias("docs"))
    df = tf.groupBy("token").agg(F.count("*").alias("df")).join(F.broadcast(n))
    weight = (1 + F.log("tf")) * (F.log((F.col("docs") + 1) / (F.col("df") + 1)) + 1)
    return tf.join(df, "token").select(key, "token", weight.alias("weight"))


def top_n(counts: DataFrame, by: str, value: str, n: int, tie: str = "token") -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.col(value).desc(), tie)
    return counts.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)


def distinctive_keywords(docs: DataFrame, by: str, words: Column, min_share: float = 0.34, n: int = 8) -> DataFrame:
    """(group, token, share, lift, rank): tokens of a large share of a group's rows, by lift over all rows."""
    each = docs.select(by, F.explode(F.array_distinct(words)).alias("token")).where(meaningful(F.col("token")))
    in_group = each.groupBy(by, "token").agg(F.count("*").alias("n"))
    overall = in_group.groupBy("token").agg(F.sum("n").alias("all"))
    sizes = docs.groupBy(by).agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size").alias("total"))
    found = in_group.join(sizes, by).where(F.col("n") / F.col("size") >= min_share).join(overall, "token").join(F.broadcast(total))
    found = found.select(by, "token", round3(F.col("n") / F.col("size")).alias("share"), round3((F.col("n") / F.col("size")) / (F.col("all") / F.col("total"))).alias("lift"))
    return top_n(found, by, "lift", n)


def best_match(want: DataFrame, have: DataFrame, least: float = 0.55) -> DataFrame:
    """(want_id, have_id, similarity): the item that holds most of the wanted tokens; the first id on ties.

    want and have are (want_id, tokens) and (have_id, tokens); an equi join on
    tokens, never all pairs.
    """
    w = want.select("want_id", F.size(F.array_distinct("tokens")).alias("n"), F.explode(F.array_distinct("tokens")).alias("token"))
    h = have.select("have_id", F.explode(F.array_distinct("tokens")).alias("token"))
    common = w.join(h, "token").groupBy("want_id", "have_id", "n").agg(F.count("*").alias("common"))
    common = common.withColumn("similarity", F.col("common") / F.col("n")).where(F.col("similarity") >= least)
    order = Window.partitionBy("want_id").orderBy(F.col("similarity").desc(), "have_id")
    return common.withColumn("r", F.row_number().over(order)).where("r = 1").select("want_id", "have_id", round3(F.col("similarity")).alias("similarity"))


def leader_clusters(arcs: DataFrame, part: str, threshold: float = 0.42) -> DataFrame:
    """(part, arc, cluster): arcs (part, arc, steps) of a part that alike step sets hold together; the cluster is its least arc.

    Equal step sets are one class, so copies make no pairs; classes are joined on
    their rarest steps. Arcs without steps are one class. No order of arcs is
    needed, so a part is not tied to one task, as the sequential leader pass would be.
    """
    each = arcs.select(part, "arc", F.array_sort(step_set(F.col("steps"))).alias("items"))
    classes = each.groupBy(part, "items").agg(F.struct(F.col(part), F.min("arc").alias("arc")).alias("id"))
    own = F.transform("items", lambda x: F.concat_ws(" | ", F.col(part).cast("string"), x))
    found = groups(classes.select("id"), jaccard_pairs(classes.select("id", own.alias("items")), threshold))
    named = classes.join(found, "id").select(part, "items", F.col("group.arc").alias("cluster"))
    return each.join(named, [part, "items"]).select(part, "arc", "cluster")
