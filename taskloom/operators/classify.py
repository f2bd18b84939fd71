"""What a scored candidate should become."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clamp

#: Beginnings of a first step that starts work by itself.
TRIGGERS = {
    "shell:git commit": "after a commit", "shell:git push": "after a push", "shell:gh pr create": "when a pull request is opened", "shell:gh pr merge": "after a pull request merges",
    "shell:npm run build": "after a build", "shell:shopify theme": "after a theme push", "shell:vercel deploy": "after a deploy", "shell:vercel": "after a deploy", "shell:terraform appl": "after an apply",
}
READING, CHANGING = ["read", "search", "list", "web_fetch"], ["edit", "write", "browser"]


def trigger(steps: Column, first_support: Column) -> Column:
    """What the runs follow, for three steps or more of which nearly all runs have the first; else null."""
    out = F.lit(None).cast("string")
    for begin, phrase in TRIGGERS.items():
        out = F.coalesce(out, F.when(F.get(steps, 0).startswith(begin), F.lit(phrase)))
    return F.when((F.size(steps) >= 3) & (first_support >= 0.8), out)


def is_reference(steps: Column) -> Column:
    """Two steps or more that nearly all read and never change a thing."""
    reading = F.size(F.filter(steps, lambda s: s.isin(*READING)))
    changing = F.size(F.filter(steps, lambda s: s.isin(*CHANGING) | s.startswith("shell:")))
    return (F.size(steps) >= 2) & (changing == 0) & (reading / F.greatest(F.size(steps), F.lit(1)) >= 0.8)


def classify(candidates: DataFrame, min_score: float = 28.0) -> DataFrame:
    """candidates with kind and confidence.

    They have total, steps, first_support, regularity, skill_ref and
    skill_share (null for none), and match (the similarity of the best installed
    artifact, null for none).
    """
    c = F.col
    few = (F.size("steps") <= 3) & (c("regularity") > 0.4)
    cases = [
        (F.coalesce(c("skill_ref"), F.lit("")) != "", "update", c("skill_share")), (c("match").isNotNull(), "update", c("match")), (c("total") < min_score, "ignore", 1 - c("total") / 100),
        (trigger(c("steps"), c("first_support")).isNotNull(), "hook", F.lit(0.7)), (is_reference(c("steps")), "reference", F.lit(0.6)), (few, "command", F.lit(0.65)),
    ]
    kind, sure = F.lit("skill"), clamp(c("total") / 100)
    for holds, name, confidence in reversed(cases):
        kind, sure = F.when(holds, F.lit(name)).otherwise(kind), F.when(holds, confidence).otherwise(sure)
    return candidates.withColumns({"kind": kind, "confidence": sure})


def classify_rules(rules: DataFrame) -> DataFrame:
    """rules (occurrences, and match: the similarity of a rules file that covers them, null for none) with kind and confidence."""
    covered = F.col("match").isNotNull()
    return rules.withColumns({"kind": F.when(covered, "ignore").otherwise("rule"), "confidence": F.when(covered, F.col("match")).otherwise(clamp(F.col("occurrences") / 5))})
