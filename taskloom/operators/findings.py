"""From turns to named, scored and ranked findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import meaningful, tokens
from ..sources.inventory import best_match, named_alike
from ..written import written
from . import candidates, classify, mining, naming, scoring, segment
from .clusters import cluster_arcs, intent_tokens
from .leaders import numbered

MOST_CORRECTIONS = 6


def vocabulary(title: Column, phrases: Column, keywords: Column, commands: Column) -> Column:
    """What a finding is matched by: the words of its title, phrases, keywords and commands that are fit to show."""
    of = [tokens(title), F.flatten(F.transform(phrases, lambda p: tokens(p["phrase"]))), keywords, F.flatten(F.transform(commands, lambda c: tokens(c)))]
    return F.array_distinct(F.filter(F.concat(*of), meaningful))


def _lists(df: DataFrame, by: str, *columns: str) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, F.array().cast(df.schema[c].dataType)) for c in columns})


def gathered(arcs: DataFrame, min_runs: int = 3, min_sessions: int = 2, min_support: float = 0.45) -> DataFrame:
    """One row for each cluster of arcs, of ``min_runs`` arcs and ``min_sessions`` sessions at least, with all that names, scores and places it."""
    members, sizes = cluster_arcs(arcs, min_runs=min_runs)
    members, sizes = written(members), written(sizes)
    words = intent_tokens(F.col("intent"), F.col("prompts"), F.col("commands"))
    every = written(arcs.withColumn("words", words).join(members, ["arc_id", "session"], "left"))
    a = every.where("cluster is not null")
    by = "cluster"
    told = candidates.summary(a, by).where(F.col("sessions") >= min_sessions)
    wishes = a.select(by, F.explode("wishes").alias("w")).groupBy(by).agg(F.count("*").alias("said"), F.array_sort(F.collect_list(F.struct("w.at", "w.kind"))).alias("w"))
    wishes = wishes.select(by, F.least("said", F.lit(MOST_CORRECTIONS)).alias("n_corrections"), F.size(F.filter(F.slice("w", 1, MOST_CORRECTIONS), lambda x: x["kind"] == "preference")).alias("n_standing"))
    steps = mining.canonical_steps(a, by, min_support).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", "action", "support"))).alias("s"))
    steps = steps.select(by, F.transform("s", lambda x: x["action"]).alias("steps"), F.col("s")[0]["support"].alias("first_support"))
    sets = a.groupBy(by).agg(F.array_sort(F.collect_set("agent")).alias("agents"), F.array_sort(F.collect_set(F.nullif("repo", F.lit("")))).alias("repos"), F.min(F.struct("start", "arc_id", "intent")).alias("first"))
    sets = sets.select(by, "agents", "repos", F.col("first.intent").alias("said"))
    # Arcs of no cluster are what phrases and keywords are told apart from.
    texts = every.select(F.coalesce(by, F.lit(0).cast("long")).alias(by), F.concat_ws("/", "session", "arc").alias("key"), F.filter(tokens(F.substring("intent", 1, 600)), meaningful).alias("w"), "words")
    phrases = candidates.top_phrases(candidates.phrase_scores(texts, by, F.col("w"), "key"), by)
    keywords = mining.distinctive_keywords(texts, by, F.col("words")).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]).alias("keywords"))
    c = told.join(sizes.select(by, "cohesion"), by).join(mining.cadence(a, by), by)
    for part in (steps, wishes, sets, candidates.top_values(a, by, "commands", 10), candidates.top_values(a, by, "tools", 8), candidates.top_values(a, by, "paths", 6), candidates.skill_share(a, by), candidates.dominant_verb(a, by, "intent"), phrases, keywords):
        c = c.join(part, by, "left")
    c = _lists(c, by, "steps", "agents", "repos", "commands", "tools", "paths", "phrases", "keywords")
    none = F.lit(0)
    return written(c.withColumns({"n_corrections": F.coalesce("n_corrections", none), "n_standing": F.coalesce("n_standing", none), "n_repos": F.size("repos"), "n_agents": F.size("agents"), "phrase": F.get("phrases", F.lit(0))["score"]}))


def findings(turns: DataFrame, items: DataFrame | None = None, idle_minutes: int = 90, min_runs: int = 3, min_sessions: int = 2, min_score: float = 28.0) -> DataFrame:
    """What people do again and again, best first: rank, id, title, slug, summary, kind, confidence, total, reasons, existing and the counts behind them.

    ``items`` are installed skills, commands and rules files (``installed``); a
    finding that one of them covers, or whose runs call for a skill, is an
    update of it, and ``existing`` its path. Rank follows the score, then the id.
    """
    c = naming.named(gathered(written(segment.arcs(turns, idle_minutes)), min_runs, min_sessions))
    c = written(scoring.score(c))
    if items is None:
        c = c.withColumns({"match": F.lit(None).cast("double"), "existing": F.lit(None).cast("string")})
    else:
        wanted = c.select(F.col("cluster").alias("id"), vocabulary(F.col("title"), F.col("phrases"), F.col("keywords"), F.col("commands")).alias("tokens"))
        covered = best_match(wanted, items.where("kind in ('skill', 'command')")).select(F.col("id").alias("cluster"), "match", F.col("path").alias("covering"))
        called = named_alike(c.where("skill_ref is not null").select(F.col("cluster").alias("id"), F.col("skill_ref").alias("name")), items).select(F.col("id").alias("cluster"), F.col("path").alias("called"))
        c = c.join(covered, "cluster", "left").join(called, "cluster", "left").withColumn("existing", F.when(F.col("skill_ref").isNotNull(), F.col("called")).otherwise(F.col("covering"))).drop("covering", "called")
    c = classify.classify(c, min_score)
    ranked = numbered(c.withColumn("_less", -F.col("total")), "_less", "id", "cluster")
    return ranked.select((F.col("n") + 1).alias("rank"), "id", "title", "slug", "summary", "kind", "confidence", "existing", "total", "reasons", "penalties", "cluster", "runs", "sessions", "days", "label", "cohesion", "turns", "minutes", "error_rate", "steps", "commands", "tools", "paths", "phrases", "keywords", "agents", "repos", "skill_ref")


def actionable(found: DataFrame) -> DataFrame:
    """The findings that propose something."""
    return found.where("kind <> 'ignore'")


def rules(turns: DataFrame, idle_minutes: int = 90, min_runs: int = 2) -> DataFrame:
    """Standing wishes that people said in two sessions or more, most frequent first by ``occurrences`` and ``rule_id``."""
    a = segment.arcs(turns, idle_minutes).select("session", "agent", "repo", F.explode("wishes").alias("w")).where("w.kind = 'preference'")
    wishes = a.select("session", "agent", "repo", F.col("w.at").alias("at"), F.substring("w.text", 1, 280).alias("text"))
    grouped = candidates.group_wishes(wishes, ["at", "text", "session"])
    return candidates.rule_groups(grouped.drop("group"), grouped.select("id", "group"), min_runs)


def window(turns: DataFrame) -> DataFrame:
    """(earliest, latest) of all turns."""
    return turns.agg(F.min("at").alias("earliest"), F.max("at").alias("latest"))
