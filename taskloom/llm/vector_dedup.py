"""Near-duplicate vectors by sorted projection passes.

A pass orders the vectors of a label by a string of random hashes: the signs of
random projections of the vector less the label's mean, one after the other,
compared lexicographically. Vectors within ``window`` places of each other are
compared exactly. A neighbour is found in a pass less often the more vectors a
label has, so the number of passes grows with the label (``passes_for``). The
links of all passes are united into components. A dense component holds more
links than the windows can see, so its members are then held against each other
in blocks, and each vector's links are counted exactly.

A pass is range-partitioned in its order, and each task walks its sorted rows
with the last ``window`` of them in hand. Only the first and last ``window`` rows
of a partition are sent on, to be compared across its borders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, stored, with_row_id

#: Members of a component in one block.
BLOCK = 1024
#: Sorted rows in one task.
PART = 50_000


def passes_for(n: Column, least: int) -> Column:
    """Passes for a label of n vectors: ``least`` up to 10,000, then as the fifth root of n.

    A pass finds a pair at the threshold among n spread vectors with a
    probability that falls about as the fifth root of n (0.39 at 20,000, 0.19 at
    1,000,000), so this keeps what all passes miss at about one in a thousand.
    """
    return F.greatest(F.lit(least), F.ceil(F.pow(n / F.lit(10_000), 0.2) * F.lit(least))).cast("int")


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _scaled(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _unit(vectors: list) -> np.ndarray:
    return _scaled(np.stack([np.asarray(v, np.float64) for v in vectors]))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, dim, number, sum) of the unit vectors of each batch."""
    for batch in batches:
        codes = batch.column("label").dictionary_encode()
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            x, code = _scaled(_matrix(batch.column("vec").take(pa.array(at)), int(dim))), codes.indices.to_numpy()[at]
            some = np.unique(code)
            total = np.stack([x[code == c].sum(axis=0) for c in some])
            yield pa.RecordBatch.from_arrays(
                [codes.dictionary.take(pa.array(some)), pa.array(np.full(len(some), dim, np.int32)), pa.array([int((code == c).sum()) for c in some], pa.int64()), pa.array(list(total), pa.list_(pa.float64()))],
                names=["label", "dim", "n", "total"],
            )


def _keys(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """Each vector once per pass of its label, with its 32 projection signs as one number, first sign highest."""
    weights = np.uint64(1) << np.arange(31, -1, -1, dtype=np.uint64)
    for batch in batches:
        dims, passes = batch.column("dim").to_numpy(), batch.column("passes").to_numpy()
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim))
            x, most = _scaled(_matrix(part.column("vec"), int(dim))) - _matrix(part.column("mean"), int(dim)), passes[dims == dim]
            for p in range(int(most.max())):
                planes = np.random.default_rng((seed, p, int(dim))).standard_normal((int(dim), 32))
                at = np.flatnonzero(most > p)
                bits = ((x[at] @ planes) > 0) @ weights
                few = part.take(pa.array(at)) if len(at) < len(x) else part
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), p, np.int32)), few.column("label"), few.column("dim"), pa.array(bits.astype(np.int64)), few.column("_rid"), few.column("vec")],
                    names=["pass", "label", "dim", "bits", "_rid", "vec"],
                )


def _least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    lab = np.arange(n)
    while len(i):
        low = np.minimum(lab[i], lab[j])
        before = lab.copy()
        np.minimum.at(lab, i, low)
        np.minimum.at(lab, j, low)
        lab = lab[lab]
        if (lab == before).all():
            break
    return lab


def _near(x: np.ndarray, window: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows at most ``window`` apart, as a star for each set of linked rows."""
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, min(window, len(x) - 1) + 1):
        i = np.flatnonzero(np.einsum("ij,ij->i", x[:-d], x[d:]) >= threshold)
        found_i.append(i)
        found_j.append(i + d)
    lab = _least_labels(len(x), np.concatenate(found_i), np.concatenate(found_j))
    some = np.flatnonzero(lab != np.arange(len(x)))
    return lab[some], some


def _stars(rows: pa.Table, window: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links within rows in the order of the passes; only those of one pass, label and length are compared."""
    ids = rows.column("_rid").to_numpy()
    codes = [rows.column(c).combine_chunks().dictionary_encode().indices.to_numpy() for c in ("pass", "label", "dim")]
    new = np.zeros(len(ids), bool)
    for c in codes:
        new[1:] |= c[1:] != c[:-1]
    cuts, dims = [0, *np.flatnonzero(new).tolist(), len(ids)], rows.column("dim").to_numpy()
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        if hi - lo > 1:
            i, j = _near(_scaled(_matrix(rows.column("vec").slice(lo, hi - lo).combine_chunks(), int(dims[lo]))), window, threshold)
            a.append(ids[lo + i])
            b.append(ids[lo + j])
    return np.concatenate(a), np.concatenate(b)


_SORTED = ["pass", "label", "dim", "_rid", "vec"]


def _walk(batches: Iterator[pa.RecordBatch], window: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links (a, b) along a sorted partition, and its first and last rows with the border they stand at."""
    part, seen, held = TaskContext.get().partitionId(), 0, None

    def rows_at(border: int, rows: pa.Table, first: int) -> Iterator[pa.RecordBatch]:
        n = len(rows)
        at = pa.array((np.int64(part) << 33) + first + np.arange(n))
        yield from pa.table([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(np.full(n, border, np.int32)), at, *rows.columns], names=["a", "b", "border", "at", *_SORTED]).combine_chunks().to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        fresh = pa.Table.from_batches([batch]).select(_SORTED)
        if seen < window:
            yield from rows_at(part - 1, fresh.slice(0, window - seen), seen)
        both = fresh if held is None else pa.concat_tables([held, fresh])
        a, b = _stars(both, window, threshold)
        n = len(a)
        none = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), *(pa.nulls(n, fresh.schema.field(c).type) for c in _SORTED)]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *none], names=["a", "b", "border", "at", *_SORTED])
        seen += batch.num_rows
        held = both.slice(max(0, len(both) - window)).combine_chunks()
    if held is not None:
        yield from rows_at(part, held, seen - len(held))


def _across(rows: pa.Table, window: int, threshold: float) -> pa.Table:
    a, b = _stars(rows.sort_by("at"), window, threshold)
    return pa.table({"a": a, "b": b})


def _count_links(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links between two blocks of a component; several small components may share a group."""
    out = []
    for _, part in pdf.groupby("component", sort=False):
        first, second = part[part["blk"] == part["i"]], part[part["blk"] == part["j"]]
        x = _unit(first["vec"].tolist()) if len(first) else np.zeros((0, 1))
        if part["i"].iloc[0] == part["j"].iloc[0]:
            near = (x @ x.T) >= threshold
            np.fill_diagonal(near, False)
            out.append(pd.DataFrame({"_rid": first["_rid"], "n": near @ first["copies"].to_numpy()}))
        elif len(first) and len(second):
            near = (x @ _unit(second["vec"].tolist()).T) >= threshold
            out.append(pd.DataFrame({"_rid": first["_rid"], "n": near @ second["copies"].to_numpy()}))
            out.append(pd.DataFrame({"_rid": second["_rid"], "n": near.T @ first["copies"].to_numpy()}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"_rid": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64")})


def near_vectors(df: DataFrame, threshold: float = 0.93, passes: int = 16, window: int = 64, seed: int = 11, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept): one row per row of df.

    df must be read from files. Vectors link when their labels are equal and not
    null, their lengths are equal and their cosine, in double precision, is at
    least ``threshold``. Null, zero and empty vectors, and those with a null or
    non-finite component, link with nothing. Equal vectors are compared once and
    counted as often as they stand, so repeated rows link with each other;
    repeated keys are separate vectors. component_id is the least key reachable
    (null keys come last); kept marks the row whose key it is. No rows give none.
    ``passes`` is the least number; ``passes_for`` gives a large label more.
    """
    # Single precision is widened only in the comparison: half the bytes are moved.
    kind = "array<float>" if dict(df.dtypes)[vector] == "array<float>" else "array<double>"
    rows = with_row_id(df.select(F.col(key).alias("k"), F.col(label).alias("label"), F.col(vector).cast(kind).alias("vec")))
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.select("_rid", "k", "label", F.when(F.col("label").isNotNull() & F.coalesce(sound, F.lit(False)), F.col("vec")).alias("vec"))
    reps = stored(rows.where("vec is not null").groupBy("label", "vec").agg(F.min("_rid").alias("_rid"), F.count("*").alias("copies")))
    name = dict(reps.dtypes)["label"]
    sized = reps.select("label", F.size("vec").alias("dim"), "_rid", "vec")
    sums = sized.select("label", "dim", "vec").mapInArrow(_sums, f"label {name}, dim int, n long, total array<double>")
    cells = sums.select("label", "dim", "n", F.posexplode("total").alias("at", "x")).groupBy("label", "dim", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    means = cells.groupBy("label", "dim").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", (F.col("x") / F.col("n")).alias("x")))).alias("mean"))
    means = stored(means.select("label", "dim", "n", passes_for(F.col("n"), passes).alias("passes"), F.transform("mean", lambda c: c["x"]).alias("mean")))
    n, places = means.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("passes")), F.lit(0))).first()
    keyed = sized.join(means.drop("n"), ["label", "dim"]).mapInArrow(lambda it: _keys(it, seed), f"pass int, label {name}, dim int, bits long, _rid long, vec {kind}")
    order = ["pass", "label", "dim", "bits", "_rid"]
    ordered = keyed.repartitionByRange(max(1, -(-places // PART)), *order).sortWithinPartitions(*order)
    walked = stored(ordered.mapInArrow(lambda it: _walk(it, window, threshold), f"a long, b long, border int, at long, pass int, label {name}, dim int, _rid long, vec {kind}"))
    across = walked.where("border is not null").drop("a", "b").groupBy("border").applyInArrow(lambda t: _across(t, window, threshold), "a long, b long")
    links = walked.where("border is null").select("a", "b").union(across).distinct()
    parts_of = stored(connected_components(links))
    sizes = parts_of.groupBy("component").agg(F.count("*").alias("size"))
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    members = reps.select("_rid", "vec", "copies").join(parts_of.withColumnRenamed("id", "_rid"), "_rid").join(sizes, "component")
    members = members.withColumn("blocks", blocks).withColumn("blk", F.pmod(F.xxhash64("_rid"), F.col("blocks")).cast("int"))
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("blk")).alias("i"), F.greatest(x, F.col("blk")).alias("j"))))
    packets = max(1, n // BLOCK)
    packet = F.when(F.col("blocks") > 1, F.col("component")).otherwise(-1 - F.pmod(F.xxhash64("component"), F.lit(packets)))
    dealt = members.withColumn("packet", packet).select("packet", "component", "_rid", "vec", "copies", "blk", pairs.alias("p")).select("packet", "component", "_rid", "vec", "copies", "blk", "p.i", "p.j")
    counted = dealt.groupBy("packet", "i", "j").applyInPandas(lambda pdf: _count_links(pdf, threshold), "_rid long, n long").groupBy("_rid").agg(F.sum("n").alias("n"))
    rep_links = stored(reps.select("label", "vec", F.col("_rid").alias("rep"), "copies").join(counted.withColumnRenamed("_rid", "rep"), "rep", "left").join(parts_of.withColumnRenamed("id", "rep"), "rep", "left").select("label", "vec", "rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")))
    named = rows.join(rep_links, ["label", "vec"], "left").select("_rid", "k", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "_rid").alias("component"))
    named = stored(named)
    least = named.groupBy("component").agg(F.min("k").alias("component_id"))
    out = named.join(least, "component")
    return out.select(F.col("k").alias(key), "n_links", "component_id", F.coalesce(F.col("k") == F.col("component_id"), F.lit(False)).alias("kept"))
