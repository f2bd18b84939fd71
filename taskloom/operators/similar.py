"""Pairs of rows that are alike, by inverted index and prefix filter, and groups of them."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, shingles
from ..written import written


def _pairs(index: DataFrame) -> DataFrame:
    a, b = index.select("token", F.col("id").alias("a")), index.select("token", F.col("id").alias("b"))
    return a.join(b, "token").where("a < b").select("a", "b").distinct()


def jaccard_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard): all pairs of (id, items) with a similarity of ``threshold`` (over 0) or more, a < b.

    Only the rarest items of a set, whose number its size fixes, are joined, and
    only sets whose sizes and places of the item leave room for the similarity.
    Empty sets are in no pair; ids must differ. Equal sets make pairs like
    others: where many are equal, join their ``classes``.
    """
    s = sets.select("id", F.array_distinct("items").alias("items")).where("size(items) > 0")
    each = s.select("id", F.size("items").alias("n"), F.explode("items").alias("token"))
    df = each.groupBy("token").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "token"))
    index = each.join(df, "token").withColumn("r", rank).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    a, b = (index.select("token", F.col("id").alias(x), F.col("n").alias(f"n{x}"), (F.col("n") - F.col("r")).alias(f"left{x}")) for x in "ab")
    need = F.ceil((F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-9)
    room = (F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9) & (F.least("lefta", "leftb") + F.least(F.col("na") - F.col("lefta"), F.col("nb") - F.col("leftb")) >= need)
    pairs = a.join(b, "token").where("a < b").where(room).select("a", "b").distinct()
    found = pairs.join(s.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(s.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    return found.select("a", "b", jaccard(F.col("x"), F.col("y")).alias("jaccard")).where(F.col("jaccard") >= threshold)


def cosine_of(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with ``cosine`` of the sparse vectors (id, token, weight); 0 where they share nothing."""
    norms = vectors.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    x = vectors.select(F.col("id").alias("a"), "token", F.col("weight").alias("wa"))
    y = vectors.select(F.col("id").alias("b"), "token", F.col("weight").alias("wb"))
    dots = pairs.select("a", "b").join(x, "a").join(y, ["b", "token"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    out = pairs.join(dots, ["a", "b"], "left")
    for side in "ab":
        out = out.join(norms.select(F.col("id").alias(side), F.col("norm").alias(f"norm_{side}")), side, "left")
    size = F.coalesce(F.col("norm_a") * F.col("norm_b"), F.lit(0.0))
    return out.withColumn("cosine", F.when(size > 0, F.coalesce("dot", F.lit(0.0)) / size).otherwise(F.lit(0.0))).drop("dot", "norm_a", "norm_b")


def cosine_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """(a, b, cosine): all pairs of sparse vectors (id, token, weight) with a cosine of ``threshold`` (over 0) or more, a < b.

    Of each vector, taken from its rarest token on, only as many tokens are
    joined as leave a rest shorter than ``threshold`` times the vector.
    """
    df = vectors.groupBy("token").agg(F.count("*").alias("df"))
    order = Window.partitionBy("id").orderBy("df", "token")
    square = F.col("weight") * F.col("weight")
    before, all_ = F.sum(square).over(order) - square, F.sum(square).over(Window.partitionBy("id"))
    index = vectors.join(df, "token").select("id", "token", (all_ - before).alias("rest"), all_.alias("all")).where(F.col("rest") >= F.col("all") * (threshold * threshold) * (1 - 1e-9))
    return cosine_of(_pairs(index), vectors).where(F.col("cosine") >= threshold)


def step_set(steps: Column) -> Column:
    return F.array_union(F.array_distinct(steps), F.when(F.size(steps) > 1, shingles(steps, 2)).otherwise(F.array().cast("array<string>")))


def blended_pairs(vectors: DataFrame, sets: DataFrame, threshold: float = 0.42, weight: float = 0.55) -> DataFrame:
    """(a, b, cosine, jaccard, similarity): pairs with weight x cosine + (1 - weight) x jaccard of ``threshold`` or more.

    Such a pair has one of the two at the threshold at least, so both joins
    together miss none. Two empty sets count as equal: rows with an empty set are
    paired with the first of them only, which holds them together just as well.
    """
    s = sets.select("id", F.array_distinct("items").alias("items"))
    empty = s.where("size(items) = 0").select("id")
    star = empty.crossJoin(F.broadcast(empty.agg(F.min("id").alias("first")))).where("id > first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    near = cosine_pairs(vectors, threshold).select("a", "b").union(jaccard_pairs(sets, threshold).select("a", "b")).union(star).distinct()
    both = cosine_of(near, vectors).join(s.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(s.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    both = both.withColumn("jaccard", jaccard(F.col("x"), F.col("y"))).drop("x", "y")
    return both.withColumn("similarity", F.col("cosine") * weight + F.col("jaccard") * (1 - weight)).where(F.col("similarity") >= threshold)


def _checkpointed(df: DataFrame) -> DataFrame:
    """checkpoint() in the folder that ``spark.checkpoint.dir`` names; on one machine, where none is named, in one of our own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="taskloom-"))
    return df.checkpoint()


def groups(ids: DataFrame, links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(id, group): the least id that links (a, b) reach; ids without links are their own group.

    Each round a row takes the least group among its neighbours' and then that
    group's own, so paths halve; lineage is cut by checkpoint().
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both, now = _checkpointed(both), _checkpointed(ids.select("id", F.col("id").alias("group")))
    for _ in range(most_rounds):
        near = both.join(now.select(F.col("id").alias("b"), "group"), "b").groupBy(F.col("a").alias("id")).agg(F.min("group").alias("near"))
        least = now.join(near, "id", "left").select("id", "group", F.least("group", F.coalesce("near", "group")).alias("least"))
        roots = now.select(F.col("id").alias("least"), F.col("group").alias("of_least"))
        after = _checkpointed(least.join(roots, "least").select("id", F.least("least", "of_least").alias("after"), "group").toDF("id", "group", "was"))
        now = after.select("id", "group")
        if after.where("group != was").isEmpty():
            return now
    raise RuntimeError("groups did not settle")


def classes(vectors: DataFrame, sets: DataFrame, threshold: float = 0.42, weight: float = 0.55) -> DataFrame:
    """(id, class): rows with the very same vector and set stand together, named by the least id.

    A row that is not even like itself by the threshold, having no vector, is a
    class of its own.
    """
    told = vectors.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("token", "weight"))).alias("vector"))
    rows = sets.select("id", F.array_sort(F.array_distinct("items")).alias("items")).join(told, "id", "left").withColumn("alone", F.when(F.col("vector").isNull() & F.lit(1 - weight < threshold), F.col("id")))
    same = rows.groupBy("items", "vector", "alone").agg(F.min("id").alias("class"))
    on = [rows[c].eqNullSafe(same[c]) for c in ("items", "vector", "alone")]
    return rows.join(same, on).select("id", "class")


def alike_groups(vectors: DataFrame, sets: DataFrame, threshold: float = 0.42, min_runs: int = 3) -> DataFrame:
    """(id, group): rows that blended similarity holds together, in groups of ``min_runs`` at least; only different rows are joined."""
    of = written(classes(vectors, sets, threshold))
    firsts = of.where(F.col("id") == F.col("class")).select("id")
    found = groups(firsts, blended_pairs(vectors.join(firsts, "id", "left_semi"), sets.join(firsts, "id", "left_semi"), threshold))
    found = of.join(found.withColumnRenamed("id", "class"), "class").select("id", "group")
    kept = found.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") >= min_runs).select("group")
    return found.join(kept, "group").select("id", "group")


def cohesion(members: DataFrame, vectors: DataFrame, sets: DataFrame, weight: float = 0.55) -> DataFrame:
    """(group, cohesion): the mean blended similarity of the members (id, group) to their group's mean vector and united set."""
    v = members.join(vectors, "id")
    sizes = members.groupBy("group").agg(F.count("*").alias("n"))
    centre = v.groupBy("group", "token").agg(F.sum("weight").alias("total")).join(sizes, "group").select("group", "token", (F.col("total") / F.col("n")).alias("mean"))
    long_ = centre.groupBy("group").agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("centre_norm"))
    own = v.groupBy("group", "id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    dot = v.join(centre, ["group", "token"]).groupBy("group", "id").agg(F.sum(F.col("weight") * F.col("mean")).alias("dot"))
    cos = members.join(dot, ["group", "id"], "left").join(own, ["group", "id"], "left").join(long_, "group", "left")
    s = members.join(sets.select("id", F.array_distinct("items").alias("items")), "id")
    items = s.select("group", "id", F.size("items").alias("n_items"))
    united = s.select("group", F.explode("items").alias("item")).distinct().groupBy("group").agg(F.count("*").alias("n_all"))
    both = cos.join(items, ["group", "id"]).join(united, "group", "left")
    size = F.coalesce(F.col("norm") * F.col("centre_norm"), F.lit(0.0))
    cosine = F.when(size > 0, F.coalesce("dot", F.lit(0.0)) / size).otherwise(F.lit(0.0))
    alike = F.when(F.coalesce("n_all", F.lit(0)) == 0, F.lit(1.0)).otherwise(F.col("n_items") / F.col("n_all"))
    return both.groupBy("group").agg(F.least(F.lit(1.0), F.avg(cosine * weight + alike * (1 - weight))).alias("cohesion"))
