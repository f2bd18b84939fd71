"""URL filtering by association rules, and by host and path rules.

Spark's FP-growth finds token combinations that go with the label ``block`` in
labelled URLs; rules below the support, confidence or lift asked for are pruned,
and so are rules that a shorter rule implies. A rule is kept in an inverted
index under its rarest token; a URL looks up its tokens and holds the rules
found against its whole token set. Explicit host and path rules come first.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth, FPGrowthModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = "=block"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule_holds(rule: str) -> Column:
    rule_host, slash, rule_path = rule.partition("/")
    of_host = (F.col("host") == rule_host) | F.col("host").endswith("." + rule_host)
    return of_host & F.col("path").startswith(slash + rule_path) if slash else of_host


def longest_rule(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of the (rule, verdict) that fits ``host`` and ``path``; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        rule, verdict = F.when(_rule_holds(text), F.lit(text)).otherwise(rule), F.when(_rule_holds(text), F.lit(said)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, the labels of the host and once more its first, path segments, query keys, and keys with their values.

    None is left out, whatever the length. Null and unparsable URLs have none.
    """
    labels = F.split(host(url), r"\.")
    segments = F.filter(F.split(path(url), "/"), lambda s: s != "")
    fields = F.filter(F.split(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), "&"), lambda s: s != "")
    all_ = F.concat(
        F.array(F.concat(F.lit("s:"), F.regexp_extract(url, r"(?s)^(.*?)://", 1))),
        F.transform(labels, lambda s: F.concat(F.lit("h:"), s)),
        F.array(F.concat(F.lit("f:"), F.element_at(labels, 1))),
        F.transform(segments, lambda s: F.concat(F.lit("p:"), s)),
        F.transform(fields, lambda s: F.concat(F.lit("q:"), F.substring_index(s, "=", 1))),
        F.transform(F.filter(fields, lambda s: s.contains("=")), lambda s: F.concat(F.lit("v:"), s)),
    )
    return F.when(host(url) != "", F.array_distinct(all_)).otherwise(F.array().cast("array<string>"))


def _token_classes(rows: DataFrame, least: int) -> DataFrame:
    """(rep, token): the tokens of ``least`` rows at least; those of the very same rows have one rep.

    The rows of a token are told by the distinct token sets it is in: their number and two sums of hashes.
    """
    each = rows.groupBy("t").agg(F.count("*").alias("n")).select("n", F.xxhash64("t").cast("decimal(38,0)").alias("h1"), F.xxhash64(F.lit(1), "t").cast("decimal(38,0)").alias("h2"), F.explode("t").alias("token"))
    seen = each.groupBy("token").agg(F.sum("n").alias("n"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2")).where(F.col("n") >= least)
    return seen.groupBy("n", "h1", "h2").agg(F.min("token").alias("rep"), F.collect_list("token").alias("tokens")).select("rep", F.explode("tokens").alias("token"))


#: Rows that a rule must hold for at least, however few the labelled rows are: less says nothing, and on few rows a share of them bounds no combination.
LEAST_ROWS = 20


def _good_rules(model: FPGrowthModel, n: int, min_confidence: float, min_lift: float) -> DataFrame:
    """(rule, confidence, lift, support) that no shorter good rule of as much confidence implies.

    Sizes are taken in turn: all subsets of a frequent set are frequent, so the
    surest good rule within a set is the surest of what its subsets of one token
    less hold, and sets are joined with these alone, never with all rules.
    """
    sets = model.freqItemsets
    with_block = sets.where(F.array_contains("items", BLOCK))
    blocked = F.array_sort(F.array_remove("items", BLOCK))
    all_ = with_block.where(F.size("items") == 1).select(F.col("freq").alias("n_block"))
    each = with_block.where(F.size("items") > 1).select(blocked.alias("rule"), F.col("freq").alias("both")).join(sets.select(F.array_sort("items").alias("rule"), "freq"), "rule")
    each = each.join(F.broadcast(all_)).select("rule", (F.col("both") / F.col("freq")).alias("confidence"), (F.col("both") / F.col("freq") / (F.col("n_block") / n)).alias("lift"), (F.col("both") / n).alias("support"))
    each = stored(each.withColumn("good", (F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift)))
    found, surest = None, None
    for size in range(1, (each.agg(F.max(F.size("rule"))).first()[0] or 0) + 1):
        mine = each.where(F.size("rule") == size)
        if surest is not None:
            parts = mine.select("rule", F.explode(F.transform("rule", lambda t: F.array_remove("rule", t))).alias("part"))
            within = parts.join(surest.withColumnRenamed("rule", "part"), "part").groupBy("rule").agg(F.max("surest").alias("within"))
            mine = mine.join(within, "rule", "left")
        else:
            mine = mine.withColumn("within", F.lit(None).cast("double"))
        mine = stored(mine)
        surest = mine.select("rule", F.greatest("within", F.when(F.col("good"), F.col("confidence"))).alias("surest"))
        kept = mine.where("good and (within is null or within < confidence)").select("rule", "confidence", "lift", "support")
        found = kept if found is None else found.union(kept)
    return found if found is not None else each.select("rule", "confidence", "lift", "support")


def mine_rules(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.5, min_lift: float = 1.2, url: str = "url", block: str = "block") -> DataFrame:
    """(rule, confidence, lift, support): token sets that go with ``block``.

    ``labelled`` has a URL and a boolean; rows where either is null teach
    nothing. Repeated rows count as often as they stand. No labelled row, or
    none of the rules good enough, gives no rule. A rule holds for
    ``min_support`` of the rows and for ``LEAST_ROWS`` rows at least. A rule
    that contains a kept shorter rule of no less confidence is dropped.
    """
    rows = stored(labelled.where(F.col(url).isNotNull() & F.col(block).isNotNull()).select(F.array_sort(tokens(F.col(url))).alias("t"), F.col(block).alias("block")))
    # Tokens below the support are in no rule. Tokens of the very same rows are mined as one: a rule with two of them says no more than with one.
    n = max(1, rows.count())
    least = max(LEAST_ROWS, math.ceil(min_support * n))
    classes = stored(_token_classes(rows, least))
    sets = rows.select("t").distinct()
    mapped = sets.select("t", F.explode("t").alias("token")).join(classes, "token").groupBy("t").agg(F.collect_set("rep").alias("reps"))
    reps = F.coalesce("reps", F.array().cast("array<string>"))
    items = rows.join(mapped, "t", "left").select(F.when(F.col("block"), F.array_append(reps, F.lit(BLOCK))).otherwise(reps).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / n), minConfidence=min_confidence).fit(stored(items))
    kept = stored(_good_rules(model, n, min_confidence, min_lift))
    # Each rule once for every choice of a token from each of its classes.
    members = classes.groupBy("rep").agg(F.collect_list("token").alias("tokens"))
    choices = kept.select("rule", F.explode("rule").alias("rep")).join(members, "rep").groupBy("rule").agg(F.collect_list("tokens").alias("choices"))
    none = F.array(F.array().cast("array<string>"))
    made = F.aggregate("choices", none, lambda done, some: F.flatten(F.transform(done, lambda d: F.transform(some, lambda t: F.array_append(d, t)))))
    return kept.join(choices, "rule").select(F.explode(made).alias("rule"), "confidence", "lift", "support").withColumn("rule", F.array_sort("rule"))


def judge(pages: DataFrame, mined: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """pages with host, path, rule, mined (the surest mined rule, or null) and verdict.

    Without a rule of ``rules``, a mined rule blocks and no rule allows. Every
    row stays, repeated ones too; a null URL has empty host and path, no rule and
    the verdict allow. Columns of pages with these names are replaced.
    """
    taken = pages.drop("host", "path", "rule", "mined", "verdict")
    parsed = taken.withColumn("host", host(F.col(url))).withColumn("path", path(F.col(url))).withColumn("_tokens", F.array_sort(tokens(F.col(url))))
    rule, said = longest_rule(rules)
    parsed = parsed.withColumn("rule", rule).withColumn("_said", said).withColumn("_open", F.when(F.col("rule").isNull(), F.col("_tokens")))
    # Inverted index: each rule under its rarest token, rarity counted over the distinct token sets of all pages.
    sets = stored(parsed.where("_open is not null").select("_open").distinct())
    asked = mined.select(F.explode("rule").alias("token")).distinct()
    counts = sets.select(F.explode("_open").alias("token")).join(asked, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    postings = mined.select("rule", "confidence", F.explode("rule").alias("token")).join(counts, "token")
    index = postings.groupBy("rule", "confidence").agg(F.min(F.struct("n", "token")).alias("least")).select("rule", "confidence", F.col("least.token").alias("token"))
    hits = sets.select("_open", F.explode("_open").alias("token")).join(index, "token").where(F.size(F.array_except("rule", "_open")) == 0)
    best = hits.groupBy("_open").agg(F.max(F.struct("confidence", F.col("rule").alias("mined"))).alias("best")).select("_open", "best.mined")
    return parsed.join(best, "_open", "left").withColumn("verdict", F.coalesce("_said", F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))).drop("_tokens", "_said", "_open")
