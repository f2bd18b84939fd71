"""Arcs that are the same work done again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, round3, tokens, truncate
from ..written import written
from . import mining
from .leaders import leader_pass, numbered
from .similar import step_set


def intent_tokens(intent: Column, prompts: Column, commands: Column) -> Column:
    """What an arc is about: tokens of its intent, of the next four prompts, and of its commands."""
    later = F.flatten(F.transform(F.slice(prompts, 2, 4), lambda p: bound(truncate(p, 240), tokens)))
    return F.concat(bound(truncate(intent, 900), tokens), later, F.flatten(F.transform(commands, lambda c: tokens(c))))


def cohesion(members: DataFrame, words: DataFrame, items: DataFrame, sets: DataFrame, centres: DataFrame, weight: float = 0.55) -> DataFrame:
    """(leader, cohesion): the mean similarity of a group's members to its centre, with token weights of the group's own.

    members (n, leader), words (n, token, tf), items (n, item), sets (leader,
    item), centres (leader, token, weight). How rare a token is counts within
    the group, in one table of (group, token).
    """
    each = members.join(words, "n")
    sizes = members.groupBy("leader").agg(F.count("*").alias("size"))
    df = each.groupBy("leader", "token").agg(F.count("*").alias("df"))
    idf = df.join(sizes, "leader").select("leader", "token", (F.log((F.col("size") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    own = each.join(idf, ["leader", "token"]).select("leader", "n", "token", ((1 + F.log("tf")) * F.col("idf")).alias("own"))
    centre = centres.select("leader", "token", F.col("weight").alias("centre"))
    sums = own.join(centre, ["leader", "token"], "left").groupBy("leader", "n").agg(F.sum(F.col("own") * F.coalesce("centre", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("own") * F.col("own"))).alias("length"))
    far = centres.groupBy("leader").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("far"))
    held, all_ = items.groupBy("n").agg(F.count("*").alias("held")), sets.groupBy("leader").agg(F.count("*").alias("all"))
    both = members.join(sums, ["leader", "n"], "left").join(far, "leader", "left").join(held, "n", "left").join(all_, "leader", "left")
    none = F.lit(0.0)
    length = F.coalesce(F.col("length") * F.col("far"), none)
    cosine = F.when(length > 0, F.coalesce("dot", none) / length).otherwise(none)
    alike = F.when(F.coalesce("all", F.lit(0)) == 0, F.lit(1.0)).otherwise(F.coalesce("held", F.lit(0)) / F.col("all"))
    return both.groupBy("leader").agg(F.least(F.lit(1.0), F.avg(cosine * weight + alike * (1 - weight))).alias("cohesion"))


def cluster_arcs(arcs: DataFrame, threshold: float = 0.42, weight: float = 0.55, merge_at: float = 0.55, min_runs: int = 3) -> tuple[DataFrame, DataFrame]:
    """((arc_id, session, cluster), (cluster, runs, cohesion)): arcs in groups of ``min_runs`` at least, the largest group being 1.

    Arcs (arc_id, session, start, intent, prompts, commands, steps) are grouped
    in the order of time, then of arc_id and session, and groups of one size by
    the first arc_id. Arcs without a start come first. Two arcs of equal id,
    session and start stand in no set order.
    """
    rows = written(numbered(arcs.select("arc_id", F.col("session").alias("session"), "start", intent_tokens(F.col("intent"), F.col("prompts"), F.col("commands")).alias("tokens"), step_set(F.col("steps")).alias("set")), "start", "arc_id", "session"))
    words = written(rows.select("n", F.explode("tokens").alias("token")).groupBy("n", "token").agg(F.count("*").alias("tf")))
    items = written(rows.select("n", F.explode("set").alias("item")))
    vectors = written(mining.tfidf(rows, "n", F.col("tokens")))
    groups, sets, centres = leader_pass(rows, items, vectors, threshold, weight, merge_at)
    sizes = groups.join(rows.select("n", "start", "arc_id"), "n").groupBy("leader").agg(F.count("*").alias("runs"), F.min(F.struct("start", "arc_id")).alias("first")).where(F.col("runs") >= min_runs)
    ranked = numbered(sizes.select("leader", "runs", (-F.col("runs")).alias("less"), F.col("first.arc_id").alias("first")), "less", "first", "leader")
    ranked = written(ranked.select("leader", "runs", (F.col("n") + 1).alias("cluster")))
    members = groups.join(ranked.select("leader", "cluster"), "leader")
    near = cohesion(members.select("n", "leader"), words, items, sets, centres, weight)
    named = members.join(rows.select("n", "arc_id", "session"), "n").select("arc_id", "session", "cluster")
    return named, ranked.join(near, "leader").select("cluster", "runs", round3(F.col("cohesion")).alias("cohesion"))
