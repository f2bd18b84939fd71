"""MinHash near-dedup with DartMinHash signatures.

A document is a weighted set: its word shingles, each weighing as often as it
stands, or that times its inverse document frequency. Over the plane of weight and
rank of an element fall darts of a Poisson process that hashing fixes for that
element, the same in every document; strips of weight that double in width make
it, so that a document opens only those its own weight reaches. It throws the
darts below its weight and up to a rank that its total weight sets, about k ln k
in all, and keeps the earliest dart of each of k coordinates. Two documents agree
in a coordinate as often as their weighted Jaccard similarity, for any weights.

Bands of coordinates are joined on their hashes; documents that share a band hang
together loosely, and within such a loose component the pairs are held against
each other in blocks: signatures first, then the exact similarity, skipping pairs
that are linked already. The verified links give the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext
from .common import connected_components, stored, with_row_id

BANDS, ROWS = 20, 5
SHINGLE = 5
#: Documents of a loose component in one block.
BLOCK = 512
#: Standard deviations of the signature's estimate below the threshold at which a pair is still verified.
SLACK = 4.0
#: Elements whose weights are broadcast, at most: those of one in as many rows or more.
MOST_COMMON = 1000

_MASK = np.uint64((1 << 50) - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STRIP = np.uint64(0xC2B2AE3D27D4EB4F)
_ODD = np.uint64(0xD1342543DE82EF95)


def weighted_elements(data: np.ndarray, offs: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, element, weight, digest 1 of texts, digest 2 of texts), sorted by text and element.

    An element is a shingle, its weight how often it stands in the text. A text
    of fewer words than ``shingle``, but not none, is one shingle. Digests are of
    the whole sequence of words, 0 for a text without words.
    """
    n = len(offs) - 1
    start, end, doc = bytetext.words(data, offs, bytetext.ALNUM[0])
    h = bytetext.span_hash(bytetext.prefix_sums(data, bytetext.ALNUM[1]), start, end)
    first = np.searchsorted(doc, np.arange(n + 1))
    some = np.diff(first) > 0
    digests = []
    for x in (h, bytetext.mix(h ^ _ODD)):
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * bytetext._power(bytetext._BASE, len(x)), out=sums[1:])
        digests.append(np.where(some, bytetext.mix((sums[first[1:]] - sums[first[:-1]]) * bytetext._power(bytetext._INVERSE, len(x) + 1)[first[:-1]] + np.diff(first).astype(np.uint64)), np.uint64(0)))
    short = np.flatnonzero(some & (np.diff(first) < shingle))
    if len(h) >= shingle:
        grams = np.zeros(len(h) - shingle + 1, np.uint64)
        for k in range(shingle):
            grams = grams * _STEP + h[k : len(h) - shingle + 1 + k]
        whole = doc[: len(grams)] == doc[shingle - 1 :]
        grams, at = bytetext.mix(grams[whole]), doc[: len(grams)][whole]
    else:
        grams, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys = np.concatenate([(at.astype(np.uint64) << np.uint64(50)) | (grams & _MASK), (short.astype(np.uint64) << np.uint64(50)) | (digests[0][short] & _MASK)])
    keys.sort()
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    keys, weight = keys[first], np.diff(np.append(first, len(keys))).astype(np.float64)
    return (keys >> np.uint64(50)).astype(np.int64), keys & _MASK, weight, digests[0], digests[1]


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def _strips(doc: np.ndarray, element: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, seed, width, share) of the strips of weight that the elements reach: [0, 1), [1, 2), [2, 4), [4, 8) and so on.

    The seed is the strip's own; share is the part of it that lies below the weight.
    """
    if not len(weight) or weight.max() <= 1:
        return doc, bytetext.mix(element), np.ones(len(weight)), weight
    more = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))), 0).astype(np.int64)
    at = np.repeat(np.arange(len(weight)), more + 1)
    strip = np.arange(len(at)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
    width = np.ldexp(1.0, np.maximum(strip - 1, 0))
    low = np.where(strip == 0, 0.0, width)
    return doc[at], bytetext.mix(element[at] + strip.astype(np.uint64) * _STRIP), width, np.minimum((weight[at] - low) / width, 1.0)


def dart_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """n x k signatures of 32 bits from (text index, element, weight) rows; texts without elements get zeros.

    Weights are any positive numbers; of those far below 1 most darts are thrown in vain.
    """
    out = np.zeros((n, k), np.uint32)
    total = np.bincount(doc, weight, n)
    todo = np.flatnonzero(total)
    rank = np.zeros(n)
    rank[todo] = (np.log(k) + 2.0) / total[todo]
    doc, seed, width, share = _strips(doc, element, weight)
    while len(todo):
        wanted = np.zeros(n, bool)
        wanted[todo] = True
        live = np.flatnonzero(wanted[doc])
        time = np.zeros(len(live))
        cells, times, names = [], [], []
        turn = 0
        while len(live):
            dart = bytetext.mix(seed[live] + np.uint64((turn + 1) * int(_ODD) % 2**64))
            time = time - np.log(_uniform(dart)) / (k * width[live])  # the next dart of a process with k darts for each unit of weight and rank
            inside = time <= rank[doc[live]]
            live, time, dart = live[inside], time[inside], dart[inside]
            hit = np.flatnonzero((share[live] >= 1) | (_uniform(bytetext.mix(dart ^ _STRIP)) < share[live]))  # darts above the weight fall beside the region
            name = bytetext.mix(dart[hit] ^ _STEP)
            cells.append(doc[live[hit]] * k + ((name >> np.uint64(32)) % np.uint64(k)).astype(np.int64))
            times.append(time[hit])
            names.append((name & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            turn += 1
        cell, when, name = np.concatenate(cells), np.concatenate(times), np.concatenate(names)
        order = np.argsort(-when)  # the last write of a cell is its earliest dart
        got, found = np.zeros(n * k, np.uint32), np.zeros(n * k, bool)
        got[cell[order]] = name[order]
        found[cell] = True
        full = found.reshape(n, k).all(axis=1) & wanted
        out[full] = got.reshape(n, k)[full]
        todo = np.flatnonzero(wanted & ~full)
        rank[todo] *= 2
    return out


def _sketch(batches: Iterator[pa.RecordBatch], shingle: int, k: int, sets: bool) -> Iterator[pa.RecordBatch]:
    """The digests of each text with words, and its signature or, with ``sets``, its elements and how often each stands."""
    for batch in batches:
        for first, n, data, offs in bytetext.slices(batch.column(1)):
            doc, element, weight, d1, d2 = weighted_elements(data, offs, shingle)
            size = np.bincount(doc, minlength=n)
            some = np.flatnonzero(size)
            columns = [batch.column(0).slice(first, n).take(pa.array(some)), pa.array(d1[some].view(np.int64)), pa.array(d2[some].view(np.int64))]
            if sets:
                cut = pa.array(np.concatenate([[0], np.cumsum(size[some])]), pa.int32())
                columns += [pa.ListArray.from_arrays(cut, pa.array(element.view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(weight))]
            else:
                sig = dart_signatures(doc, element, weight, n, k)
                columns.append(pa.array([sig[i].tobytes() for i in some], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["_rid", "d1", "d2", "elements", "weights"] if sets else ["_rid", "d1", "d2", "sig"])


def _sign(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Signatures of weighted sets, about 2 MB of elements at once."""
    for batch in batches:
        cut = batch.column("elements").offsets.to_numpy()
        at = 0
        while at < len(batch):
            to = min(max(at + 1, int(np.searchsorted(cut, cut[at] + (1 << 18), "right")) - 1), len(batch))
            element = batch.column("elements").values.to_numpy()[cut[at] : cut[to]].view(np.uint64)
            weight = batch.column("weights").flatten().to_numpy(zero_copy_only=False)[cut[at] - cut[0] : cut[to] - cut[0]]
            sig = dart_signatures(np.repeat(np.arange(to - at), np.diff(cut[at : to + 1])), element, weight, to - at, k)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array([x.tobytes() for x in sig], pa.binary())], names=["_rid", "sig"])
            at = to


def _sets_of(pdf: pd.DataFrame, shingle: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(elements, weights) of each row, sorted by element: as they are, or of the text."""
    if "elements" in pdf:
        return [(np.asarray(e).view(np.uint64), np.asarray(w)) for e, w in zip(pdf["elements"], pdf["weights"])]
    raw = [t.encode("utf-8", "surrogatepass") for t in pdf["text"]]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
    sets = []
    for at in range(0, len(pdf), 4096):
        to = min(len(pdf), at + 4096)
        doc, element, weight, _, _ = weighted_elements(data[offs[at] : offs[to]], offs[at : to + 1] - offs[at], shingle)
        cut = np.searchsorted(doc, np.arange(to - at + 1))
        sets += [(element[cut[i] : cut[i + 1]], weight[cut[i] : cut[i + 1]]) for i in range(to - at)]
    return sets


def _shared(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The sum of the lesser weights of the elements in both."""
    place = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = np.flatnonzero(b[0][place] == a[0])
    return float(np.minimum(a[1][both], b[1][place[both]]).sum())


def _verify(pdf: pd.DataFrame, threshold: float, shingle: int, k: int) -> pd.DataFrame:
    """Links that hold the documents of two blocks together, each verified."""
    sets = _sets_of(pdf, shingle)
    total = [float(w.sum()) for _, w in sets]
    ids = pdf["_rid"].to_numpy()
    sig = np.stack([np.frombuffer(s, np.uint32) for s in pdf["sig"]])
    least = threshold - SLACK * np.sqrt(threshold * (1 - threshold) / k)
    root = np.arange(len(pdf))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for _, at in pdf.groupby("component", sort=False).indices.items():
        blk, i, j = pdf["blk"].to_numpy()[at], pdf["i"].iloc[at[0]], pdf["j"].iloc[at[0]]
        first, second = (at, at) if i == j else (at[blk == i], at[blk == j])
        if not len(first) or not len(second):
            continue
        same = np.zeros((len(first), len(second)), np.uint16)
        for c in range(k):
            same += sig[first, c][:, None] == sig[second, c][None, :]
        a, b = np.nonzero(same >= least * k)
        if i == j:
            a, b = a[a < b], b[a < b]
        for x in np.argsort(-same[a, b].astype(np.int32), kind="stable"):
            u, v = first[a[x]], second[b[x]]
            if find(u) == find(v):
                continue
            both = _shared(sets[u], sets[v])
            if both >= threshold * (total[u] + total[v] - both):
                links.append((ids[u], ids[v]))
                root[find(u)] = find(v)
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _rarity_weighted(sets: DataFrame) -> DataFrame:
    """(_rid, elements, weights): counts times ln(1 + documents / documents that hold the element).

    ``sets`` has one row a class with its number of documents. At most
    ``MOST_COMMON`` elements can stand in so large a share of the rows as to be
    hot; these are broadcast, the others joined.
    """
    rows = stored(sets.select("_rid", "documents", F.explode(F.arrays_zip("elements", "weights")).alias("e")).select("_rid", "documents", F.col("e.elements").alias("element"), F.col("e.weights").alias("weight")))
    n = sets.agg(F.sum("documents").alias("n"))
    seen = stored(rows.groupBy("element").agg(F.sum("documents").alias("df"), F.count("*").alias("rows")).crossJoin(F.broadcast(n)).select("element", F.log1p(F.col("n") / F.col("df")).alias("idf"), "rows"))
    least = rows.count() // MOST_COMMON + 1
    common = F.broadcast(seen.where(F.col("rows") >= least).select("element", F.col("idf").alias("common")))
    marked = rows.join(common, "element", "left")
    joined = marked.where("common is null").join(seen.where(F.col("rows") < least).select("element", "idf"), "element").select("_rid", "element", (F.col("weight") * F.col("idf")).alias("weight"))
    every = joined.union(marked.where("common is not null").select("_rid", "element", F.col("weight") * F.col("common")))
    whole = every.groupBy("_rid").agg(F.array_sort(F.collect_list(F.struct("element", "weight"))).alias("e"))
    return whole.select("_rid", F.col("e.element").alias("elements"), F.col("e.weight").alias("weights"))


def near_groups(docs: DataFrame, threshold: float = 0.8, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, text: str = "text", key: str = "doc_id", rarity: bool = False) -> DataFrame:
    """(_rid, key, group_id, group_size, kept): one row per row of docs.

    docs must be read from files. Words are runs of letters and digits of the
    lower-cased text. Documents with the same words in the same order form a
    class; classes link when their weighted Jaccard similarity over word shingles
    is at least ``threshold``; a group is what links hold together. A shingle
    weighs as often as it stands, with ``rarity`` times ln(1 + N / n), of N
    documents with words and n that hold it. group_id is
    the least key of the group, null last; kept marks one row of each group, the
    first by key, then by row number, so repeated rows and repeated or null keys
    keep one too. Texts without words (null, empty, signs only) link with
    nothing and are kept; their group_id is their own key. No other column of
    docs is read or returned, whatever its name. No rows give none.
    """
    k = bands * rows
    base = with_row_id(docs.select(F.col(key).alias("k"), F.coalesce(F.lower(F.col(text)), F.lit("")).alias("text"))).select("_rid", "k", "text")
    made = "_rid long, d1 long, d2 long, " + ("elements array<long>, weights array<double>" if rarity else "sig binary")
    sketch = stored(base.select("_rid", "text").mapInArrow(lambda it: _sketch(it, shingle, k, rarity), made))
    classes = sketch.groupBy("d1", "d2").agg(F.min("_rid").alias("rep"), F.count("*").alias("documents"))
    firsts = classes.select(F.col("rep").alias("_rid"), "documents")
    if rarity:
        content = stored(_rarity_weighted(sketch.join(firsts, "_rid").select("_rid", "documents", "elements", "weights")))
        reps = stored(content.mapInArrow(lambda it: _sign(it, k), "_rid long, sig binary"))
    else:
        content = base.select("_rid", "text")
        reps = stored(sketch.join(firsts, "_rid", "left_semi").select("_rid", "sig"))
    held = [c for c in content.columns if c != "_rid"]
    width = rows * 4
    band = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.substring("sig", b * width + 1, F.lit(width))))
    banded = reps.select("_rid", F.explode(band).alias("band"))
    shared = banded.groupBy("band").agg(F.min("_rid").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n")
    loose = stored(connected_components(banded.join(shared, "band").where("_rid != lead").select(F.col("lead").alias("a"), F.col("_rid").alias("b")).distinct()))
    sizes = loose.groupBy("component").agg(F.count("*").alias("size"))
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    packets = max(1, loose.count() // BLOCK)
    members = loose.join(sizes, "component").withColumn("blocks", blocks).withColumn("blk", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    packet = F.when(F.col("blocks") > 1, F.col("component")).otherwise(-1 - F.pmod(F.xxhash64("component"), F.lit(packets)))
    members = members.select(F.col("id").alias("_rid"), "component", "blocks", "blk", packet.alias("packet")).join(reps, "_rid").join(content, "_rid")
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("blk")).alias("i"), F.greatest(x, F.col("blk")).alias("j"))))
    dealt = members.select("packet", "component", "_rid", "blk", "sig", *held, pairs.alias("p")).select("packet", "component", "_rid", "blk", "sig", *held, "p.i", "p.j")
    links = dealt.groupBy("packet", "i", "j").applyInPandas(lambda pdf: _verify(pdf, threshold, shingle, k), "a long, b long")
    groups = stored(connected_components(links))
    of_class = classes.join(groups.withColumnRenamed("id", "rep"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component"))
    of_doc = sketch.select("_rid", "d1", "d2").join(of_class, ["d1", "d2"]).select("_rid", "component")
    named = stored(base.select("_rid", "k").join(of_doc, "_rid", "left").select("_rid", "k", F.coalesce("component", "_rid").alias("component")))
    order = F.struct(F.col("k").isNull().alias("none"), "k", "_rid")
    heads = named.groupBy("component").agg(F.min(order).alias("head"), F.count("*").alias("group_size"))
    return named.join(heads, "component").select("_rid", F.col("k").alias(key), F.col("head.k").alias("group_id"), "group_size", (F.col("_rid") == F.col("head._rid")).alias("kept"))
