"""Mixing sources to target weights by pivotal dependent rounding.

Each document has a wanted number of copies, target / size of its source. The
whole part is taken as it is; the fractional part is rounded so that the words
of a source stay what they were: two fractional documents meet, mass moves from
one to the other, weighed by their sizes, until one of them is whole, and the
other goes on. A task rounds one bounded group of documents and leaves at most
one fractional document; the leftovers meet again in groups of ``fan_in``, level
by level, until one is left for a source.

That last one may be a long document, so a bounded number of documents of each
source, drawn by hash, sit out the pairing. The last one is drawn with its
fraction, and those that sat out are then taken or left, longest first, so that
the source's words meet its target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, with_row_id

WORDS = r"[^\x20\x09-\x0D]+"
CYCLE = (5.0, 2.0, 1.0)
GROUP = 2_000
FAN_IN = 64
#: Documents of a source that sit out: so many at most, and at most a quarter of its first group.
SIT_OUT = 64


def source_targets(sizes: DataFrame, cycle: tuple[float, ...] = CYCLE, most: float = 3.0) -> DataFrame:
    """(source, n_docs, source_size, target): one row a source.

    Weights repeat ``cycle`` over the sources in code point order, null last. A
    target is the smaller of ``most`` times the source's size and level x weight;
    the level is such that the targets add up to all sizes. The frame has one
    row a source, so its one ordering task holds names and sums only.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, cycle)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(cycle))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    # Sources reach their caps in the order of cap / weight as the level rises.
    rise = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total, weights = F.sum("source_size").over(Window.partitionBy()), F.sum("weight").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum("cap").over(rise), F.lit(0.0))) / (weights - F.coalesce(F.sum("weight").over(rise), F.lit(0.0)))
    per = per.withColumn("level_here", level)
    per = per.withColumn("level", F.max(F.when(F.col("cap") >= F.col("level_here") * F.col("weight"), F.col("level_here"))).over(Window.partitionBy()))
    return per.select("source", "n_docs", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _draw(seed: np.ndarray, other: np.ndarray) -> np.ndarray:
    x = (seed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (other.astype(np.uint64) + np.uint64(0xBF58476D1CE4E5B9))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(11)).astype(np.float64) / 2.0**53


def pivot_chain(size: np.ndarray, part: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Fractions after the chain: 0 or 1 but for one at most, with the same sum of size x fraction."""
    eps = 1e-9
    draws = _draw(key, np.roll(key, 1)).tolist()
    out, size = part.astype(float).tolist(), size.tolist()
    held = -1
    for j in range(len(out)):
        if not eps < out[j] < 1 - eps:
            out[j] = round(out[j])
            continue
        if held < 0:
            held = j
            continue
        i = held
        give = min(out[i] * size[i], (1 - out[j]) * size[j])  # words that may go from i to j
        take = min((1 - out[i]) * size[i], out[j] * size[j])  # and from j to i
        words = give if draws[j] * (give + take) < take else -take
        out[i] -= words / size[i]
        out[j] += words / size[j]
        for k in (i, j):
            if out[k] < eps or out[k] > 1 - eps:
                out[k] = round(out[k])
        held = next((k for k in (j, i) if 0 < out[k] < 1), -1)
    return np.array(out, float)


def settle(size: np.ndarray, part: np.ndarray, key: np.ndarray, waits: np.ndarray) -> np.ndarray:
    """The last group of a source: every fraction becomes 0 or 1."""
    out = part.astype(float).copy()
    chain = np.flatnonzero(~waits)
    out[chain] = pivot_chain(size[chain], part[chain], key[chain])
    owed = float((part[waits] * size[waits]).sum())
    for k in chain[(out[chain] > 0) & (out[chain] < 1)]:
        taken = float(_draw(key[k : k + 1], key[k : k + 1] + 1)[0] < out[k])
        owed += (out[k] - taken) * size[k]
        out[k] = taken
    for k in sorted(np.flatnonzero(waits), key=lambda k: (-size[k], key[k], k)):
        out[k] = float(owed >= size[k])
        owed -= out[k] * size[k]
    left = [k for k in np.flatnonzero(waits) if out[k] == 0 and abs(owed - size[k]) < abs(owed)]
    if left:
        out[min(left, key=lambda k: (abs(owed - size[k]), key[k], k))] = 1.0
    return out


def _round_groups(batches: Iterator[pd.DataFrame], first: bool, last: bool) -> Iterator[pd.DataFrame]:
    """Rows come sorted by (source, bucket); a group may span batches."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if len(pdf):
            open_ = (pdf["sid"] == pdf["sid"].iloc[-1]) & (pdf["bucket"] == pdf["bucket"].iloc[-1])
            rest = pdf[open_]
            if not open_.all():
                yield _rounded(pdf[~open_], first, last)
    if rest is not None and len(rest):
        yield _rounded(rest, first, last)


def _rounded(pdf: pd.DataFrame, first: bool, last: bool) -> pd.DataFrame:
    pdf = pdf.reset_index(drop=True)
    size, part, key, waits = (pdf[c].to_numpy(copy=True) for c in ("size", "part", "key", "waits"))
    for (_, bucket), at in pdf.groupby(["sid", "bucket"], sort=False).indices.items():
        if first and bucket == 0:
            waits[at[np.argsort(_draw(key[at], size[at]), kind="stable")[: min(SIT_OUT, len(at) // 4)]]] = True
        if last:
            part[at] = settle(size[at], part[at], key[at], waits[at])
        else:
            chain = at[~waits[at]]
            part[chain] = pivot_chain(size[chain], part[chain], key[chain])
    return pdf.assign(part=part, waits=waits)


def mix_sources(docs: DataFrame, cycle: tuple[float, ...] = CYCLE, most: float = 3.0, seed: int = 1, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """(_rid, size, source, source_size, target, copies): one row per row of ``docs``.

    ``docs`` must be read from files (its rows are numbered). Size is the number
    of words, null and empty texts have 0 and 0 copies. Null sources are one
    source, the last. Repeated rows are separate documents. Draws depend on
    ``key``, size and ``seed`` alone, so reruns agree; null keys draw alike.
    ``copies`` is at most ``most``; the words taken from a source differ from
    its target by less than one document's. An empty table gives no rows.
    """
    sizes = stored(
        with_row_id(docs.select(F.col(source).alias("source"), F.col(key).alias("k"), F.col(text).alias("t"))).select(
            "_rid", "source", F.coalesce(F.regexp_count("t", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), "k", F.length("t")).alias("key")
        )
    )
    targets = stored(source_targets(sizes, cycle, most).withColumn("sid", F.xxhash64("source", F.col("source").isNull())))
    named = sizes.join(F.broadcast(targets) if targets.count() <= 10_000 else targets, sizes["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    share = F.when(F.abs(share - F.round(share)) < 1e-12, F.round(share)).otherwise(share)
    named = named.withColumn("copies", F.when(F.col("size") > 0, F.floor(share)).otherwise(F.lit(0)).cast("long"))
    named = named.withColumn("part", F.when(F.col("size") > 0, share - F.col("copies")).otherwise(F.lit(0.0)))
    # Neighbours in size pair up, so mass seldom has far to go; groups are dealt by the key, whatever the source's share of all rows.
    n_groups = F.ceil(F.col("n_docs") / F.lit(GROUP))
    open_ = named.where("part > 0").select("_rid", "sid", F.pmod(F.col("key"), n_groups).alias("bucket"), "size", "part", "key")
    done, most_groups = None, named.agg(F.max(n_groups)).first()[0] or 1
    open_, first = open_.withColumn("waits", F.lit(False)), True
    while True:
        last = most_groups <= 1
        dealt = open_.repartition("sid", "bucket").sortWithinPartitions("sid", "bucket", F.col("size").desc(), "key", "_rid")
        level = stored(dealt.mapInPandas(lambda it, f=first, z=last: _round_groups(it, f, z), "_rid long, sid long, bucket long, size long, part double, key long, waits boolean"))
        whole = level.where("part = 0 or part = 1").select("_rid", F.col("part").cast("long").alias("up"))
        done = whole if done is None else done.union(whole)
        if last:
            break
        most_groups, first = -(-most_groups // FAN_IN), False
        open_ = level.where("part > 0 and part < 1").withColumn("bucket", F.floor(F.col("bucket") / F.lit(FAN_IN)))
    return named.join(done, "_rid", "left").select("_rid", "size", "source", "source_size", "target", (F.col("copies") + F.coalesce("up", F.lit(0))).alias("copies"))
