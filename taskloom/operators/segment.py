"""Sessions cut into arcs of work, as windows over turns.

Turns have session, idx, actor, kind, at, text, tool, command and is_error. All
windows share the partitioning by session, so turns are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import correction_kind, fingerprint, is_continuation, truncate


def _session():
    return Window.partitionBy("session").orderBy("idx")


def _so_far():
    return _session().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def backfill(turns: DataFrame) -> DataFrame:
    """``at`` from the last dated turn before, else the first one after."""
    before = F.last("at", ignorenulls=True).over(_so_far())
    after = F.first("at", ignorenulls=True).over(_session().rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return turns.withColumn("at", F.coalesce(before, after))


def arc_turns(turns: DataFrame, idle_minutes: int = 90) -> DataFrame:
    """Turns that belong to an arc, with ``arc``, ``first`` and the action of tool calls.

    An arc starts at the first prompt or tool call after a pause of more than
    ``idle_minutes``, and at a prompt that neither continues nor corrects.
    """
    last = F.last("at", ignorenulls=True).over(_session().rowsBetween(Window.unboundedPreceding, -1))
    pause = F.coalesce(F.unix_micros("at") - F.unix_micros(last) > idle_minutes * 60_000_000, F.lit(False))
    prompt = (F.col("actor") == "user") & (F.col("kind") == "message") & (F.trim(F.coalesce("text", F.lit(""))) != "")
    t = turns.withColumn("island", F.sum(pause.cast("int")).over(_so_far())).withColumn("prompt", prompt)
    t = t.withColumn("opener", F.col("prompt") | (F.col("kind") == "tool_call"))
    t = t.withColumn("openers", F.sum(F.col("opener").cast("int")).over(Window.partitionBy("session", "island").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    fresh = F.col("prompt") & ~is_continuation(F.col("text")) & correction_kind(F.col("text")).isNull()
    t = t.withColumn("first", F.col("opener") & ((F.col("openers") == 1) | fresh))
    t = t.withColumn("arc", F.sum(F.col("first").cast("int")).over(_so_far())).where("openers > 0")
    action = F.when(F.coalesce("command", F.lit("")) != "", F.concat(F.lit("shell:"), "command")).when(F.coalesce("tool", F.lit("")) != "", F.col("tool"))
    return t.withColumn("action", F.when(F.col("kind") == "tool_call", action))


def _optional(turns: DataFrame, **types: str) -> DataFrame:
    """turns with the columns of these types that they lack, as nulls."""
    return turns.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in turns.columns})


def arcs(turns: DataFrame, idle_minutes: int = 90, min_steps: int = 2, most_prompts: int = 12) -> DataFrame:
    """One row per arc of at least ``min_steps`` steps or with a correction. Undated turns take the time of one beside them first.

    Next to counts, steps and prompts an arc has its intent (the opening prompt,
    else the first skill it calls for, else its first steps), the sorted sets of
    its tools, commands and paths, its skills in order, and the corrections as
    (idx, at, kind, text). Turns may have agent, repo, skills and paths.
    """
    turns = _optional(turns, agent="string", repo="string", skills="array<string>", paths="array<string>")
    t = arc_turns(backfill(turns), idle_minutes)
    of_arc = Window.partitionBy("session", "arc").orderBy("idx")
    calls = Window.partitionBy("session", "arc", F.col("action").isNotNull()).orderBy("idx")
    failed = F.coalesce(F.last(F.when(F.col("kind") == "tool_result", F.coalesce("is_error", F.lit(False))), ignorenulls=True).over(of_arc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    t = t.withColumn("same", F.col("action").eqNullSafe(F.lag("action").over(calls)) & F.col("action").isNotNull()).withColumn("failed", failed)
    call = F.col("kind") == "tool_call"
    counted = call | F.col("prompt") | ((F.col("actor") == "assistant") & (F.col("kind") == "message"))
    touched = F.col("first") | call | ((F.col("actor") == "assistant") & (F.col("kind") == "message"))
    wish = F.when(F.col("prompt") & ~F.col("first"), correction_kind(F.col("text")))

    def sorted_set(name: str):
        return F.array_sort(F.collect_set(F.when(call, F.nullif(name, F.lit(""))))).alias(f"{name}s")

    out = t.groupBy("session", "arc").agg(
        F.first("agent", ignorenulls=True).alias("agent"), F.first("repo", ignorenulls=True).alias("repo"),
        F.min(F.when(touched, F.col("at"))).alias("start"),
        F.max(F.when(touched, F.col("at"))).alias("end"),
        F.sum(counted.cast("int")).cast("long").alias("turns"),
        F.array_sort(F.collect_list(F.when(F.col("action").isNotNull() & ~F.col("same"), F.struct("idx", "action")))).alias("steps"),
        F.array_sort(F.collect_list(F.when(F.col("prompt"), F.struct("idx", "text")))).alias("prompts"),
        F.sum(((F.col("kind") == "tool_result") & F.coalesce("is_error", F.lit(False))).cast("int")).cast("long").alias("errors"),
        F.sum((F.col("same") & F.col("failed")).cast("int")).cast("long").alias("retries"),
        F.sum(wish.isNotNull().cast("int")).cast("long").alias("corrections"),
        F.array_sort(F.collect_list(F.when(wish.isNotNull(), F.struct("idx", "at", wish.alias("kind"), F.trim("text").alias("text"))))).alias("wishes"),
        F.min(F.when(F.col("first"), F.struct("idx", F.coalesce(F.when(F.col("prompt"), truncate(F.col("text"), 80)), F.lit("anonymous")).alias("opening"), F.col("at").alias("opened"), F.when(F.col("prompt"), F.col("text")).alias("said")))).alias("head"),
        sorted_set("tool"), sorted_set("command"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(call, F.col("paths")))))).alias("paths"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.size("skills") > 0, F.struct("idx", "skills")))), lambda x: x["skills"]))).alias("skills"),
    )
    out = out.withColumn("steps", F.transform("steps", lambda s: s["action"])).withColumn("prompts", F.slice(F.transform("prompts", lambda s: s["text"]), 1, most_prompts))
    opened = F.date_format("head.opened", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    skill = F.when(F.size("skills") > 0, F.concat(F.lit("ran the "), F.get("skills", F.lit(0)), F.lit(" skill")))
    steps = F.when(F.size("steps") > 0, F.concat(F.lit("untitled work: "), F.array_join(F.slice("steps", 1, 3), ", ")))
    intent = F.coalesce(F.nullif(F.trim("head.said"), F.lit("")), skill, steps, F.lit(""))
    out = out.withColumn("arc_id", fingerprint(F.col("session").cast("string"), opened, F.col("head.opening"))).withColumn("intent", intent).drop("head")
    return out.where((F.size("steps") >= min_steps) | (F.col("corrections") > 0))
