"""Scores of candidates: nine weighted parts, multiplied by penalties, and why.

A candidate has days, label, regularity, steps (array<string>), turns, phrase
(the best phrase's score, null for none), error_rate, n_corrections, n_standing,
n_repos, n_agents, minutes, runs, sessions and cohesion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clamp

#: Actions that only look around.
TRIVIAL = ["read", "list", "search", "shell:ls", "shell:cat", "shell:pwd", "shell:cd", "shell:git status", "shell:git diff", "shell:git log", "shell:echo", "shell:head", "shell:tail", "shell:wc"]

#: What each part weighs.
WEIGHTS = {"recurrence": 0.20, "regularity": 0.10, "complexity": 0.18, "repetition": 0.12, "friction": 0.10, "breadth": 0.08, "time_spent": 0.08, "cohesion": 0.09, "corrections": 0.05}


def recurrence(days: Column) -> Column:
    return F.when(days <= 1, F.lit(0.05)).otherwise(clamp(F.log(days.cast("double")) / F.log(F.lit(12.0))))


def complexity(steps: Column, turns: Column) -> Column:
    hard = F.size(F.filter(steps, lambda s: ~s.isin(*TRIVIAL)))
    return clamp(clamp(F.size(steps) / F.lit(8.0)) * 0.4 + clamp(turns / F.lit(25.0)) * 0.25 + clamp(hard / F.lit(5.0)) * 0.35)


def repetition(phrase: Column) -> Column:
    return F.when(phrase.isNull(), F.lit(0.1)).otherwise(clamp(phrase / 5))


def friction(error_rate: Column, n_corrections: Column) -> Column:
    return clamp(error_rate * 0.7 + F.least(n_corrections / F.lit(4.0), F.lit(1.0)) * 0.3)


def breadth(n_repos: Column, n_agents: Column) -> Column:
    return clamp(clamp((n_repos - 1) / F.lit(3.0)) * 0.6 + clamp((n_agents - 1) / F.lit(2.0)) * 0.4)


def time_spent(minutes: Column, runs: Column) -> Column:
    return F.when(minutes * runs <= 0, F.lit(0.15)).otherwise(clamp(F.log1p(minutes * runs) / F.log1p(F.lit(240.0))))


def corrections(n_standing: Column, n_corrections: Column) -> Column:
    return F.when(n_corrections == 0, F.lit(0.0)).otherwise(clamp(n_standing / F.lit(3.0) * 0.7 + n_corrections / F.lit(6.0) * 0.3))


def penalties(steps: Column, days: Column, sessions: Column, runs: Column, cohesion: Column) -> dict[str, tuple[Column, float]]:
    """Name, when it holds, and the share it takes."""
    trivial = F.size(F.filter(steps, lambda s: s.isin(*TRIVIAL)))
    return {
        "generic": ((F.size(steps) > 0) & (trivial / F.greatest(F.size(steps), F.lit(1)) > 0.8), 0.5),
        "single-step": (F.size(steps) <= 1, 0.35),
        "loose-cluster": (cohesion < 0.35, 0.3),
        "single-day": (days <= 1, 0.45),
        "in-session-loop": ((sessions < 3) & (runs >= 5), 0.25),
    }


def reasons() -> Column:
    """Up to four reasons, the strongest part first; parts below 0.2 give none."""
    notes = [
        ("recurrence", F.format_string("ran on %d separate days (%s)", "days", "label")),
        ("complexity", F.format_string("%d recurring steps, typically %d turns per run", F.size("steps"), F.col("turns").cast("long"))),
        ("breadth", F.format_string("spans %d repositories and %d agents", "n_repos", "n_agents")),
        ("friction", F.format_string("%.0f%% of runs hit an error or needed correcting", F.col("error_rate") * 100)),
        ("repetition", F.lit("the prompts repeat the same context each time")),
        ("time_spent", F.format_string("about %.0f minutes per run", "minutes")),
        ("corrections", F.format_string("%d standing corrections were issued during these runs", "n_corrections")),
    ]
    told = F.array(*(F.struct((-F.col(part)).alias("less"), F.lit(i).alias("i"), text.alias("text")) for i, (part, text) in enumerate(notes)))
    best = F.transform(F.slice(F.array_sort(F.filter(told, lambda n: n["less"] <= -0.2)), 1, 4), lambda n: n["text"])
    return F.when(F.size(best) > 0, best).otherwise(F.array(F.lit("weak signal across every dimension; shown for completeness")))


def score(candidates: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """candidates with the nine parts, ``raw`` and ``total`` (0 to 100, one place), ``penalty``, ``penalties`` and ``reasons``."""
    c = F.col
    parts = {
        "recurrence": recurrence(c("days")), "regularity": clamp(c("regularity")), "complexity": complexity(c("steps"), c("turns")), "repetition": repetition(c("phrase")),
        "friction": friction(c("error_rate"), c("n_corrections")), "breadth": breadth(c("n_repos"), c("n_agents")), "time_spent": time_spent(c("minutes"), c("runs")),
        "cohesion": clamp(c("cohesion")), "corrections": corrections(c("n_standing"), c("n_corrections")),
    }
    taken = penalties(c("steps"), c("days"), c("sessions"), c("runs"), c("cohesion"))
    factor, named = F.lit(1.0), []
    for name, (holds, amount) in taken.items():
        factor = factor * F.when(holds, F.lit(1 - amount)).otherwise(F.lit(1.0))
        named.append(F.when(holds, F.lit(name)))
    out = candidates.withColumns({"penalty": factor, "penalties": F.array_compact(F.array(*named)), **parts})
    raw = sum(((c(part) * weight) for part, weight in (weights or WEIGHTS).items()), F.lit(0.0))
    out = out.withColumn("_raw", raw)
    return out.withColumns({"raw": F.round(c("_raw") * 100, 1), "total": F.round(clamp(c("_raw") * c("penalty")) * 100, 1), "reasons": reasons()}).drop("_raw")
