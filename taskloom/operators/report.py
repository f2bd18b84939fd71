"""A report: what was read and when, the ranked findings, and the standing wishes worth writing down."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.inventory import best_match
from ..sources.transcripts import agent_stats
from ..written import written
from .candidates import kept_sessions
from .classify import classify_rules
from .findings import findings, rules
from .leaders import numbered


def cutoff(days: int, now: dt.datetime) -> dt.datetime | None:
    """The time ``days`` days before now; none for 0 days or fewer, which mean all."""
    return now - dt.timedelta(days=days) if days > 0 else None


def range_label(start: Column, end: Column) -> Column:
    """Both days, or ``undated`` where one is unknown."""
    day = "yyyy-MM-dd"
    return F.when(start.isNull() | end.isNull(), "undated").otherwise(F.concat(F.date_format(start, day), F.lit(" → "), F.date_format(end, day)))


def age_label(at: Column, now: Column) -> Column:
    """How long ago ``at`` was, in whole minutes, hours or days; ``unknown`` for null."""
    seconds = F.timestamp_diff("SECOND", at, now)
    out = F.when(at.isNull(), "unknown").when(seconds < 60, "just now")
    for most, unit, word in ((3600, 60, "minutes"), (86400, 3600, "hours")):
        out = out.when(seconds < most, F.concat(F.floor(seconds / unit).cast("string"), F.lit(f" {word} ago")))
    return out.otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit(" days ago")))


def window(stats: DataFrame) -> DataFrame:
    """One row (earliest, latest, sessions, agents, range) from the rows of ``agent_stats``; without any, nulls and zeros."""
    w = stats.agg(F.min("earliest").alias("earliest"), F.max("latest").alias("latest"), F.coalesce(F.sum("sessions"), F.lit(0)).alias("sessions"), F.count("*").alias("agents"))
    return w.withColumn("range", range_label(F.col("earliest"), F.col("latest")))


def decided(rules: DataFrame, items: DataFrame | None) -> DataFrame:
    """rules (rule_id, occurrences, keywords and others) with match, existing, kind and confidence.

    A rule that an installed rules file covers is ignored: writing it down again
    would not help. Rules without keywords are covered by nothing.
    """
    none = {"match": F.lit(None).cast("double"), "existing": F.lit(None).cast("string")}
    if items is None:
        return classify_rules(rules.withColumns(none))
    found = best_match(rules.select(F.col("rule_id").alias("id"), F.col("keywords").alias("tokens")), items.where("kind = 'rules'"))
    return classify_rules(rules.join(found.select(F.col("id").alias("rule_id"), "match", F.col("path").alias("existing")), "rule_id", "left"))


def actionable_rules(decided: DataFrame) -> DataFrame:
    """The rules that are not ignored, with ``rank``: most frequent first, then by rule_id."""
    ranked = numbered(decided.where("kind <> 'ignore'").withColumn("_less", -F.col("occurrences")), "_less", "rule_id")
    return ranked.withColumn("rank", F.col("n") + 1).drop("n", "_less")


def report(turns: DataFrame, items: DataFrame | None = None, days: int = 0, now: dt.datetime | None = None, **options) -> dict[str, DataFrame]:
    """stats, window, findings and rules of the sessions that were active in the last ``days`` days, 0 for all.

    ``items`` are what is installed; without them nothing is covered. Options
    are those of ``findings``.
    """
    since = cutoff(days, now or dt.datetime.now(dt.timezone.utc))
    if since is not None:
        placed = turns if "workspace" in turns.columns else turns.withColumn("workspace", F.lit(""))
        turns = turns.join(kept_sessions(placed, since).select("session"), "session", "left_semi")
    turns = written(turns)
    stats = agent_stats(turns)
    told = decided(rules(turns, options.get("idle_minutes", 90)), items)
    return {"stats": stats, "window": window(stats), "findings": findings(turns, items, **options), "rules": told}
