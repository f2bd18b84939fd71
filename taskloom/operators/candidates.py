"""Groups of arcs as candidates: counts, medians, evidence, phrases, verbs, rules, and how well they are ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fingerprint, first_line, log_lift, round3, tokens
from ..written import written
from .leaders import greedy_groups, numbered

#: Words that say little in a phrase; words that open a request.
LITTLE = (
    "give cool today look context proceed stop latest once thing things stuff way part bit good better best sure file files code project repo work please maybe "
    "something anything everything basically essentially actually currently"
).split()
VERBS = (
    "review fix update add remove refactor deploy verify test check draft write create build debug investigate migrate rename optimize audit triage summarize reply send publish "
    "release merge revert install configure document design implement analyze generate clean sync ship polish rewrite convert port wire set make run finish"
).split()
#: Words of a standing wish that don't say what it is about.
MARKERS = "always never forget remember sure future default time every each going forward stop".split()


def top_values(arcs: DataFrame, by: str, values: str, n: int) -> DataFrame:
    """(by, values): of an array column, the n values that most arcs of a group have, ties in alphabetical order."""
    counted = arcs.select(by, F.explode(F.array_distinct(values)).alias("v")).groupBy(by, "v").agg(F.count("*").alias("c"))
    best = counted.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.col("c").desc(), "v"))).where(F.col("r") <= n)
    return best.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda x: x["v"]).alias(values))


def summary(arcs: DataFrame, by: str) -> DataFrame:
    """(by, runs, sessions, turns, minutes, error_rate): medians over the arcs; minutes over those that took time."""
    minutes = (F.unix_micros("end") - F.unix_micros("start")) / F.lit(60e6)
    return arcs.groupBy(by).agg(
        F.count("*").alias("runs"), F.countDistinct("session").alias("sessions"),
        F.floor(F.percentile("turns", F.lit(0.5)) + 0.5).alias("turns"),
        round3(F.coalesce(F.percentile(F.when(minutes > 0, minutes), F.lit(0.5)), F.lit(0.0))).alias("minutes"),
        round3(F.avg((F.col("errors") > 0).cast("double"))).alias("error_rate"),
    )


def skill_share(arcs: DataFrame, by: str, skills: str = "skills", least: float = 0.5) -> DataFrame:
    """(by, skill_ref, skill_share): the skill that most arcs of a group mention, where it is half of them or more."""
    n = arcs.groupBy(by).agg(F.count("*").alias("n"))
    each = arcs.select(by, F.explode(F.array_distinct(skills)).alias("s")).groupBy(by, "s").agg(F.count("*").alias("c"))
    top = each.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.col("c").desc(), "s"))).where("r = 1").join(n, by)
    return top.where(F.col("c") / F.col("n") >= least).select(by, F.col("s").alias("skill_ref"), round3(F.col("c") / F.col("n")).alias("skill_share"))


def evidence(arcs: DataFrame, by: str, most: int = 8) -> DataFrame:
    """(by, pick, arc_id): up to ``most`` arcs of each group, evenly spread over its time."""
    r = F.row_number().over(Window.partitionBy(by).orderBy(F.col("start").asc_nulls_first(), "arc_id")) - 1
    n = F.count("*").over(Window.partitionBy(by))
    placed = arcs.select(by, "arc_id", r.alias("at"), n.alias("n"))
    even = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * (F.col("n") - 1) / F.lit(float(most - 1)) + 0.5).cast("int"))
    picks = F.when(F.col("n") > most, even).otherwise(F.array(F.col("at")))
    # A place can be picked once only, since there are more arcs than picks.
    pick = F.when(F.col("n") > most, F.array_position(picks, F.col("at")) - 1).otherwise(F.col("at").cast("long"))
    return placed.withColumn("pick", pick).where("pick >= 0").select(by, "pick", "arc_id")


def dominant_verb(texts: DataFrame, by: str, text: str = "text", least: float = 0.4) -> DataFrame:
    """(by, verb): the verb by which most texts of a group open, among their first four words; null where they don't agree."""
    words = F.filter(F.split(F.lower(F.coalesce(first_line(F.col(text)), F.lit(""))), r"\s+"), lambda w: w != "")
    opened = F.filter(F.transform(F.slice(words, 1, 4), lambda w: F.btrim(w, F.lit(",.:;!?`\"'"))), lambda w: w.isin(*VERBS))
    each = texts.select(by, words.alias("w"), F.get(opened, 0).alias("verb")).where("size(w) > 0")
    n = each.groupBy(by).agg(F.count("*").alias("n"))
    counted = each.where("verb is not null").groupBy(by, "verb").agg(F.count("*").alias("c"))
    top = counted.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.col("c").desc(), "verb"))).where("r = 1")
    return n.join(top, by, "left").select(by, F.when(F.col("c") / F.col("n") >= least, F.col("verb")).alias("verb"))


def informative(phrase: Column) -> Column:
    """Whether a phrase has two words or more that say something."""
    return F.size(F.filter(F.split(phrase, " "), lambda w: ~w.isin(*LITTLE))) >= 2


def phrases(words: Column) -> Column:
    """Runs of two and three words as (phrase, at): at is where the first stands, as a share of the text."""
    n = F.size(words)

    def runs(k: int) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.struct(F.array_join(F.slice(words, i + 1, k), " ").alias("phrase"), (i / F.greatest(n, F.lit(1))).alias("at")))
        return F.when(n >= k, made).otherwise(F.array().cast("array<struct<phrase:string,at:double>>"))

    return F.filter(F.concat(runs(2), runs(3)), lambda p: informative(p["phrase"]))


def phrase_scores(texts: DataFrame, by: str, words: Column, key: str, min_share: float = 0.22) -> DataFrame:
    """(by, phrase, count, score): phrases of two texts or more of a group, by how much they mark it off and how early they stand."""
    each = texts.select(by, key, F.explode(phrases(words)).alias("p")).groupBy(by, key, "p.phrase").agg(F.min("p.at").alias("at"))
    local = each.groupBy(by, "phrase").agg(F.count("*").alias("count"), F.sum("at").alias("at"))
    everywhere = local.groupBy("phrase").agg(F.sum("count").alias("df"))
    sizes = texts.groupBy(by).agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size").alias("total"))
    found = local.join(sizes, by).where((F.col("count") >= 2) & (F.col("count") / F.col("size") >= min_share)).join(everywhere, "phrase").join(F.broadcast(total))
    share = F.col("count") / F.col("size")
    outside = (F.col("df") - F.col("count")) / F.greatest(F.col("total") - F.col("size"), F.lit(1))
    longer = F.when(F.size(F.split("phrase", " ")) >= 3, F.lit(1.15)).otherwise(F.lit(1.0))
    value = share * log_lift((share + 0.01) / (outside + 0.01)) * longer * (1 - F.col("at") / F.col("count") * 0.65)
    return found.select(by, "phrase", "count", "df", value.alias("score"))


def top_phrases(scored: DataFrame, by: str, n: int = 3) -> DataFrame:
    """(by, phrases): the best phrases of a group of which no two share a word.

    Each turn takes the best phrase of every group and drops those that share a
    word with it, so all phrases of a group are looked at, in no row together.
    """
    left = written(scored.select(by, "phrase", "score", "df", F.split("phrase", " ").alias("words")))
    chosen = None
    for turn in range(n):
        best = left.groupBy(by).agg(F.min(F.struct((-F.col("score")).alias("s"), (-F.col("df")).alias("d"), "phrase", "words")).alias("best"))
        best = best.select(by, F.lit(turn).alias("turn"), F.col("best.phrase").alias("phrase"), round3(-F.col("best.s")).alias("score"), F.col("best.words").alias("taken"))
        left = left.join(best.select(by, "taken"), by).where(~F.arrays_overlap("words", "taken")).drop("taken")
        chosen = best if chosen is None else chosen.union(best)
    lists = chosen.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("turn", "phrase", "score"))).alias("phrases"))
    return lists.select(by, F.transform("phrases", lambda p: F.struct(p["phrase"].alias("phrase"), p["score"].alias("score"))).alias("phrases"))


def wish_tokens(text: Column) -> Column:
    """What a standing wish is about: its tokens without the words that only mark it."""
    return F.filter(tokens(text), lambda t: ~t.isin(*MARKERS))


def group_wishes(wishes: DataFrame, order: list[str], threshold: float = 0.34) -> DataFrame:
    """wishes (text and others) with ``id``, their number in the order of the columns, and ``group``.

    Taken in that order, a wish joins the group whose words so far are likest to
    its own, or begins one. Wishes of fewer than two words are left out.
    """
    words = F.array_distinct(wish_tokens(F.col("text")))
    placed = written(numbered(wishes.withColumn("words", words).where("size(words) >= 2"), *order).withColumnRenamed("n", "id"))
    rows, items = placed.select(F.col("id").alias("n")), placed.select(F.col("id").alias("n"), F.explode("words").alias("item"))
    nothing = items.select("n", F.col("item").alias("token"), F.lit(0.0).alias("weight")).where("false")
    found = greedy_groups(rows, items, nothing, threshold, 0.0)
    return placed.drop("words").join(found.select(F.col("n").alias("id"), F.col("leader").alias("group")), "id")


def rule_groups(wishes: DataFrame, grouped: DataFrame, min_runs: int = 2, min_sessions: int = 2) -> DataFrame:
    """(rule_id, text, theme, occurrences, sessions, agents, repos, keywords): wishes (id, session, text) in their groups (id, group).

    The text is the one that covers most of what the group shares in the fewest
    words; keywords are the eight most frequent tokens. Wishes may have agent
    and repo, whose sorted sets a rule has then.
    """
    each = wishes.join(grouped, "id")
    named = [F.array_sort(F.collect_set(F.nullif(c, F.lit("")))).alias(f"{c}s") for c in ("agent", "repo") if c in wishes.columns]
    kept = each.groupBy("group").agg(F.count("*").alias("occurrences"), F.countDistinct("session").alias("sessions"), *named).where((F.col("occurrences") >= min_runs) & (F.col("sessions") >= min_sessions))
    kept = written(kept)
    each = written(each.join(kept.select("group"), "group", "left_semi").withColumn("words", F.array_distinct(wish_tokens(F.col("text")))))
    counts = each.select("group", F.explode("words").alias("token")).groupBy("group", "token").agg(F.count("*").alias("c"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("group").orderBy(F.col("c").desc(), "token"))).where("r <= 8")
    keywords = top.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "token"))), lambda x: x["token"]).alias("keywords"))
    covered = each.select("group", "id", F.size("words").alias("n"), F.explode("words").alias("token")).join(counts.where("c > 1"), ["group", "token"], "left")
    fit = covered.groupBy("group", "id").agg((F.count("c") - F.first("n") * 0.15).alias("fit"))
    best = each.join(fit, ["group", "id"]).groupBy("group").agg(F.min(F.struct((-F.col("fit")).alias("less"), "id", "text")).alias("best"))
    out = kept.join(keywords, "group").join(best, "group")
    rule_id = fingerprint(F.lit("rule"), F.array_join("keywords", " "))
    return out.select(rule_id.alias("rule_id"), F.col("best.text").alias("text"), F.array_join(F.slice("keywords", 1, 3), " ").alias("theme"), "occurrences", "sessions", *(c for c in ("agents", "repos") if c in kept.columns), "keywords")


def ranks(truths: DataFrame, findings: DataFrame, least: float = 0.45) -> DataFrame:
    """(truth_id, rank, similarity): the first finding whose tokens a truth holds; null rank for none.

    truths are (truth_id, tokens), findings (rank, tokens); a finding matches
    where ``least`` of its tokens are the truth's.
    """
    f = findings.select("rank", F.size(F.array_distinct("tokens")).alias("n"), F.explode(F.array_distinct("tokens")).alias("token"))
    t = truths.select("truth_id", F.explode(F.array_distinct("tokens")).alias("token"))
    common = t.join(f, "token").groupBy("truth_id", "rank", "n").agg(F.count("*").alias("c")).withColumn("similarity", F.col("c") / F.col("n")).where(F.col("similarity") >= least)
    best = common.groupBy("truth_id").agg(F.min(F.struct("rank", "similarity")).alias("best")).select("truth_id", "best.*")
    return truths.select("truth_id").join(best, "truth_id", "left")


def recall(ranked: DataFrame) -> DataFrame:
    """(evaluated, recall_1, recall_3, recall_5, recall_10, mrr) over (truth_id, rank)."""
    at = [F.coalesce(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), F.lit(0.0)).alias(f"recall_{k}") for k in (1, 3, 5, 10)]
    return ranked.agg(F.count("*").alias("evaluated"), *at, F.coalesce(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), F.lit(0.0)).alias("mrr"))


def kept_sessions(turns: DataFrame, since: str | None = None, workspace: str = "", unprompted: bool = False) -> DataFrame:
    """(session, start, end): sessions with a turn that end at ``since`` or later, or undated, below a workspace, and with a prompt."""
    said = (F.col("actor") == "user") & (F.col("kind") == "message") & (F.trim(F.coalesce("text", F.lit(""))) != "")
    s = turns.groupBy("session").agg(F.min("at").alias("start"), F.max("at").alias("end"), F.max(said).alias("said"), F.max(F.lower(F.coalesce("workspace", F.lit("")))).alias("workspace"))
    if since:
        s = s.where(F.col("end").isNull() | (F.col("end") >= F.lit(since).cast("timestamp")))
    if workspace:
        s = s.where(F.contains("workspace", F.lit(workspace.lower())))
    return (s if unprompted else s.where("said")).select("session", "start", "end")


def find(ranked: DataFrame, name: str) -> DataFrame:
    """The finding with this id or slug, else the first by rank whose id or slug begins so (three characters at least)."""
    exact = (F.col("id") == name) | (F.col("slug") == name)
    begins = F.lit(len(name) >= 3) & (F.col("id").startswith(name) | F.col("slug").startswith(name))
    return ranked.where(exact | begins).orderBy((~exact).cast("int"), "rank").limit(1)
