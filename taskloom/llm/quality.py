"""Quality classifier as a sparse rule ensemble.

Statistics of a text are Spark expressions. Shallow trees are grown on labelled
rows; every path from a root is a conjunction of thresholds, a rule. A lasso
logistic regression over the rules keeps a few of them with weights, and those
are compiled into one Spark column expression that scores any text.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

STATISTICS = ["log_words", "word_length", "upper", "symbols", "marks", "digits", "pipes", "distinct", "breaks", "line_words", "stops"]

Condition = tuple[int, bool, float]  # statistic, is it above, threshold


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def statistics(text: Column, words: Column | None = None) -> Column:
    """The statistics of a text as an array of doubles; a null text counts as empty, and shares of nothing are 0.

    ``words`` is its word list, where it is there as a column: it is used often.
    """
    text, words = F.coalesce(text, F.lit("")), word_list(text) if words is None else words
    chars = F.char_length(text).cast("double")
    n = F.size(words).cast("double")

    def share(count: Column, of: Column) -> Column:
        return F.when(of > 0, count / of).otherwise(F.lit(0.0))

    def without(letters: str) -> Column:
        """How many characters are among the letters."""
        if len(letters) == 1:
            return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(letters), F.lit("")))).cast("double")
        return F.char_length(F.regexp_replace(text, f"[^{re.escape(letters)}]+", "")).cast("double")

    breaks = without("\n")
    return F.array(
        F.log1p(n),
        share(chars - n, n),
        share(without("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), chars),
        share(without("*%&$#@^~+=<>{}[]\\_"), n),
        share(without("!?"), n),
        share(without("0123456789"), chars),
        share(without("|"), n),
        share(F.size(F.array_distinct(words)).cast("double"), F.pow(n, F.lit(0.85))),
        share(breaks, n),
        share(n, breaks + 1),
        share(without("."), n),
    )


@dataclass(frozen=True)
class RuleModel:
    """intercept + sum of the weights of the rules that hold, through a logistic function."""

    intercept: float
    rules: tuple[tuple[float, tuple[Condition, ...]], ...]

    def score(self, stats: Column) -> Column:
        total = F.lit(self.intercept)
        for weight, rule in self.rules:
            total = total + F.when(_holds(stats, rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _holds(stats: Column, rule: tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for k, above, at in rule:
        out = out & (stats[k] > F.lit(at) if above else stats[k] <= F.lit(at))
    return out


def tree_rules(debug: str) -> set[tuple[Condition, ...]]:
    """All paths from the root of a printed tree, each with its redundant thresholds merged."""
    found: set[tuple[Condition, ...]] = set()
    path: list[tuple[int, Condition]] = []
    for line in debug.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth] + [(depth, (int(m[2]), m[3] == ">", float(m[4])))]
        merged: dict[tuple[int, bool], float] = {}
        for _, (k, above, at) in path:
            merged[k, above] = (max if above else min)(at, merged.get((k, above), at))
        found.add(tuple(sorted((k, above, at) for (k, above), at in merged.items())))
    return found


def fit_rules(labelled: DataFrame, stats: str = "stats", label: str = "label", trees: int = 16, depth: int = 3, lasso: float = 0.002, most_rows: int = 200_000, seed: int = 7) -> RuleModel:
    """A model from labelled rows (label 0 or 1; null labels teach nothing).

    At most about ``most_rows`` rows are used, chosen by a hash of the
    statistics; the default bound keeps training small at any corpus size. With
    one class only, or no rows, the model is a constant: the share of 1 among
    the rows, or a half.
    """
    rows = labelled.where(F.col(label).isNotNull() & F.col(stats).isNotNull()).select(F.col(stats).alias("s"), F.col(label).cast("double").alias("label"))
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < ones < n:
        share = min(max(ones / n if n else 0.5, 1e-6), 1 - 1e-6)
        return RuleModel(float(math.log(share / (1 - share))), ())
    if n > most_rows:
        rows = rows.where(F.pmod(F.xxhash64("s", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * most_rows / n))
    rows = stored(rows)
    forest = RandomForestClassifier(featuresCol="v", labelCol="label", numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="onethird", seed=seed).fit(rows.select("label", array_to_vector("s").alias("v")))
    rules = sorted(set().union(*(tree_rules(t.toDebugString) for t in forest.trees)))
    if not rules:
        share = ones / n
        return RuleModel(float(math.log(share / (1 - share))), ())
    held = F.array(*(_holds(F.col("s"), r).cast("double") for r in rules))
    fitted = LogisticRegression(featuresCol="v", labelCol="label", elasticNetParam=1.0, regParam=lasso, maxIter=60).fit(rows.select("label", array_to_vector(held).alias("v")))
    weights = [float(w) for w in fitted.coefficients]
    return RuleModel(float(fitted.intercept), tuple((w, r) for w, r in zip(weights, rules) if abs(w) > 1e-9))
