"""Benchmark decontamination: a prefix-filtered join of word windows.

A window is ``window`` consecutive words of an item, or a shorter item's all.
Containment of every word needs a prefix of one word: the rarest of the window
(the first, if several are as rare). Rarity is the frequency of a word's bucket
over all documents. The documents are read twice, however many items there are:
once to count, once to look for windows whose rarest word is the rarest of some
item's window. What tasks get for that has a fixed size: the rarity of
``BUCKETS`` buckets and two bitmaps, of rarest words and of whole windows. What
passes both is joined with the items' windows of the same number of words, all
words compared; as one window may occur in very many documents, that join is
salted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytetext
from .common import stored, with_row_id

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words are counted in so many buckets, as a power of two; levels of rarity between a frequency and its double.
BUCKETS, LEVELS = 18, 256
#: Bits of a bitmap, as a power of two: 8 MB at most, less where 32 bits a key are less.
MOST_BITS = 26
#: Parts that the occurrences of one window are dealt into.
PARTS = 16


def _word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text index, hash) of the words of a slice."""
    start, end, doc = bytetext.words(data, offs, bytetext.ALNUM[0])
    return start, end, doc, bytetext.span_hash(bytetext.prefix_sums(data, bytetext.ALNUM[1]), start, end)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKETS)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << BUCKETS, np.int64)
    for batch in batches:
        for _, _, data, offs in bytetext.slices(batch.column(0)):
            total += np.bincount(_bucket(_word_hashes(data, offs)[3]), minlength=len(total))
    some = np.flatnonzero(total)
    yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["bucket", "n"])


def _levels(texts: DataFrame) -> np.ndarray:
    """The rarity of each bucket: 0 where no document has a word of it, else higher for more frequent words."""
    found = texts.select("text").mapInArrow(_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << BUCKETS, np.int64)
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return np.floor(np.log2(counts + 1.0) * LEVELS).astype(np.int64)


def _bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """One bit for each hash, by its highest bits."""
    wanted, bits = keys.count(), 10
    while (1 << bits) < 32 * wanted and bits < MOST_BITS:
        bits += 1
    at = F.shiftrightunsigned(F.col(column), 64 - bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))
    set_ = keys.select(F.shiftright(at, 6).alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[set_["at"].to_numpy()] = set_["bits"].to_numpy()
    return out.view(np.uint64)


def _among(h: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - 5 - len(bitmap).bit_length())
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _rarest(level: np.ndarray, size: int) -> np.ndarray:
    """The place of the rarest of each ``size`` consecutive words, the first of those as rare."""
    bits = np.int64(max(1, len(level).bit_length()))
    least, have = (level << bits) | np.arange(len(level)), 1
    while have < size:
        step = min(have, size - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return least & ((np.int64(1) << bits) - 1)


def _prints(h: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of ``size`` consecutive words, by their hashes."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * bytetext._power(bytetext._BASE, len(h)), out=sums[1:])
    return bytetext.span_hash(sums, start, start + size)


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> str:
    """The words as one string, lower-cased, with single spaces."""
    base = int(start[0])
    text = data[base : int(end[-1])].tobytes().translate(_LOWERED)
    return b" ".join(text[a - base : b - base] for a, b in zip(start.tolist(), end.tolist())).decode("utf-8", "surrogatepass")


_WINDOW = "n int, print long, prefix long, words string"


def _item_windows(batches: Iterator[pa.RecordBatch], levels: np.ndarray, window: int) -> Iterator[pa.RecordBatch]:
    """(item, n, print, prefix, words) of each window all words of which may occur; prefix is the hash of its rarest."""
    for batch in batches:
        for first, n, data, offs in bytetext.slices(batch.column(1)):
            start, end, doc, h = _word_hashes(data, offs)
            level, of_item = levels[_bucket(h)], np.searchsorted(doc, np.arange(n + 1))
            sizes = np.minimum(np.diff(of_item), window)
            for size in np.unique(sizes[sizes > 0]).tolist():
                at = np.arange(len(h) - size + 1)
                rarest = _rarest(level, size)
                at = at[(doc[at] == doc[at + size - 1]) & (sizes[doc[at]] == size) & (level[rarest] > 0)]
                yield pa.record_batch(
                    [
                        batch.column(0).slice(first, n).take(pa.array(doc[at])), pa.array(np.full(len(at), size, np.int32)), pa.array(_prints(h, at, size).view(np.int64)),
                        pa.array(h[rarest[at]].view(np.int64)), pa.array([_joined(data, start[a : a + size], end[a : a + size]) for a in at.tolist()], pa.string()),
                    ],
                    names=["item", "n", "print", "prefix", "words"],
                )


def _places(batches: Iterator[pa.RecordBatch], levels: np.ndarray, sizes: list[int], prefixes: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row (_rid, n_words) a text, and one (_rid, at, n, print, words) for each of its windows that may be an item's."""
    for batch in batches:
        rids = batch.column(0)
        for first, n, data, offs in bytetext.slices(batch.column(1)):
            start, end, doc, h = _word_hashes(data, offs)
            of_doc = np.searchsorted(doc, np.arange(n + 1))
            none = pa.nulls(n, pa.int32())
            yield pa.record_batch([rids.slice(first, n), pa.array(np.diff(of_doc)), none, none, pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())], names=["_rid", "n_words", "at", "n", "print", "words"])
            level, prefix = levels[_bucket(h)], _among(h, prefixes)
            for size in sizes:
                if len(h) < size or not prefix.any():
                    continue
                at = np.flatnonzero(prefix[_rarest(level, size)] & (doc[: len(h) - size + 1] == doc[size - 1 :]))
                print_ = _prints(h, at, size)
                some = _among(print_, prints)
                at, print_ = at[some], print_[some]
                for a in range(0, len(at), 10_000):
                    some, words = at[a : a + 10_000], print_[a : a + 10_000]
                    yield pa.record_batch(
                        [
                            rids.slice(first, n).take(pa.array(doc[some])), pa.nulls(len(some), pa.int64()), pa.array((some - of_doc[doc[some]]).astype(np.int32)), pa.array(np.full(len(some), size, np.int32)),
                            pa.array(words.view(np.int64)), pa.array([_joined(data, start[k : k + size], end[k : k + size]) for k in some.tolist()], pa.string()),
                        ],
                        names=["_rid", "n_words", "at", "n", "print", "words"],
                    )


def _occurrences(docs: DataFrame, items: DataFrame, window: int, text: str, item_text: str, item_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((_rid, n_words), (_rid, win, start, stop), (win, item)): texts, verified occurrences of windows, and the items that hold those."""
    texts = with_row_id(docs.select(F.col(text).alias("text"))).select("_rid", "text")
    asked = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text"))
    levels = _levels(texts)
    kind = asked.schema["item"].dataType.simpleString()
    held = stored(asked.mapInArrow(lambda it: _item_windows(it, levels, window), f"item {kind}, {_WINDOW}").distinct())
    windows = with_row_id(stored(held.select("n", "print", "prefix", "words").distinct()), "win")
    sizes = sorted(r[0] for r in windows.select("n").distinct().collect())  # at most ``window`` numbers
    prefixes, prints = _bitmap(windows.select("prefix").distinct(), "prefix"), _bitmap(windows, "print")
    places = stored(texts.mapInArrow(lambda it: _places(it, levels, sizes, prefixes, prints), "_rid long, n_words long, at int, n int, print long, words string"))
    dealt = windows.select("win", "n", "print", "words", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    found = places.where("at is not null").drop("n_words").withColumn("part", F.pmod(F.xxhash64("_rid"), F.lit(PARTS)).cast("int"))
    found = found.join(dealt, ["print", "n", "words", "part"]).select("_rid", "win", F.col("at").alias("start"), (F.col("at") + F.col("n")).alias("stop"))
    members = held.join(windows.select("win", "n", "print", "words"), ["print", "n", "words"]).select("win", "item")
    return places.where("at is null").select("_rid", "n_words"), stored(found), members


def _with_items(found: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of ``found`` once for each item that holds their window."""
    dealt = members.select("win", "item", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    return found.withColumn("part", F.pmod(F.xxhash64("_rid"), F.lit(PARTS)).cast("int")).join(dealt, ["win", "part"]).drop("win", "part")


def contaminated_spans(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", item_text: str = "text", item_id: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """((_rid, n_words), (_rid, item, start, stop)): all rows of docs, and the occurrences found in them, stop excluded.

    ``docs`` must be read from files (its rows are numbered). Null and empty
    texts and items have no words. Items with a null id are found like others,
    with a null item. Repeated rows are separate documents; repeated items count
    once. Other columns of either table play no part. Without documents or
    items nothing is found.
    """
    counted, found, members = _occurrences(docs, items, window, text, item_text, item_id)
    return counted, _with_items(found, members).select("_rid", "item", "start", "stop")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(_rid, n_words, n_hit, n_items, items): one row per row of docs.

    A word counts once however many windows cover it; ``items`` are the ids with
    occurring windows, as sorted strings (null ids are left out). Else as
    ``contaminated_spans``.
    """
    counted, found, members = _occurrences(docs, items, window, text, item_text, item_id)
    sorted_ = Window.partitionBy("_rid").orderBy("start", "stop")
    reach = F.max("stop").over(sorted_.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), F.coalesce(reach, F.lit(0))))
    covered = found.select("_rid", "start", "stop").withColumn("new", new).groupBy("_rid").agg(F.sum("new").alias("n_hit"))
    which = _with_items(found.select("_rid", "win").distinct(), members).where("item is not null")
    which = which.groupBy("_rid").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    return (
        counted.join(covered, "_rid", "left")
        .join(which, "_rid", "left")
        .select("_rid", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    )


def word_pattern() -> re.Pattern:
    """The word of this operator, for checks in plain Python."""
    return re.compile(WORD)
