"""Importance resampling of documents towards a target distribution.

Every document and every target text is a bag of hashed word runs. The gain of a
bucket says how much likelier it is in the target than in the corpus; a
document's weight is the mean gain of its runs, and a Gumbel draw on top of the
weights samples without replacement.

Long texts are skewed work: texts of ``LONG`` bytes and more are split at word
borders into chunks of ``CHUNK_WORDS`` words, each with the first n - 1 words of
the next one behind it. A chunk owns the runs that start at its own words, so no
run is lost or counted twice. Chunks are dealt out anew; counts are summed by
bucket and weights by document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bytetext
from .common import stored, with_row_id

#: Bytes from which on a text is split, and words that a chunk owns.
LONG, CHUNK_WORDS = 1 << 15, 4096
#: Word runs hash to so many buckets: what is gathered on the driver and sent to tasks has this size.
BUCKETS = 10_000
#: Bytes of a run that are hashed for all runs at once; longer runs are finished one by one.
_TOGETHER = 48
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def _crc_on(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of what ``state`` has seen, followed by data[start:end], for all spans."""
    state, left = state ^ np.uint32(0xFFFFFFFF), np.arange(len(start))
    for k in range(min(_TOGETHER, int((end - start).max(initial=0)))):
        left = left[start[left] + k < end[left]]
        state[left] = _CRC[(state[left] ^ data[start[left] + k]) & 0xFF] ^ (state[left] >> 8)
    state ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(end - start > _TOGETHER):
        state[i] = zlib.crc32(data[start[i] + _TOGETHER : end[i]], int(state[i]))
    return state


def _runs(data: np.ndarray, offs: np.ndarray, owned: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, bucket) of every owned run of 1 to n words, and the owned words by text."""
    start, end, text = bytetext.words(data, offs, bytetext.ALNUM[0])
    of_text = np.bincount(text, minlength=len(owned))
    data, place = _FOLDED[data], np.arange(len(start)) - (np.cumsum(of_text) - of_text)[text]
    mine = np.minimum(of_text, owned)
    first = np.flatnonzero(place < mine[text])
    state = _crc_on(np.zeros(len(first), np.uint32), data, start[first], end[first])
    texts, buckets = [text[first]], [state % BUCKETS]
    for size in range(2, n + 1):
        fits = place[first] + size <= of_text[text[first]]
        first, state = first[fits], state[fits]
        state = _CRC[((state ^ np.uint32(0xFFFFFFFF)) ^ 0x20) & 0xFF] ^ ((state ^ np.uint32(0xFFFFFFFF)) >> 8) ^ np.uint32(0xFFFFFFFF)
        state = _crc_on(state, data, start[first + size - 1], end[first + size - 1])
        texts.append(text[first])
        buckets.append(state % BUCKETS)
    return np.concatenate(texts), np.concatenate(buckets), mine


def _split(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(_rid, chunk, owned, text) of long texts, cut at word borders."""
    for batch in batches:
        for row in range(batch.num_rows):
            _, _, data, offs = next(bytetext.slices(batch.column(1).slice(row, 1)))
            start, end, _ = bytetext.words(data, offs, bytetext.ALNUM[0])
            for chunk, lo in enumerate(range(0, max(len(start), 1), CHUNK_WORDS)):
                hi = min(lo + CHUNK_WORDS + n - 1, len(start))
                text = bytes(data[start[lo] : end[hi - 1]]).decode() if len(start) else ""
                yield pa.record_batch([batch.column(0).slice(row, 1), pa.array([chunk], pa.int32()), pa.array([min(CHUNK_WORDS, len(start) - lo)]), pa.array([text])], names=["_rid", "chunk", "owned", "text"])


def pieces(texts: DataFrame, n: int = 2) -> DataFrame:
    """(_rid, owned, text): short texts whole, long ones in chunks; ``owned`` is the number of words whose runs count.

    Null texts are empty.
    """
    text = F.coalesce("text", F.lit(""))
    long_ = F.octet_length(text) >= LONG
    whole = texts.where(~long_).select("_rid", F.lit(2**62).alias("owned"), text.alias("text"))
    cut = texts.where(long_).select("_rid", "text").mapInArrow(lambda it: _split(it, n), "_rid long, chunk int, owned long, text string")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return whole.union(cut.repartition(parts, "_rid", "chunk").select("_rid", "owned", "text"))


def bucket_counts(texts: DataFrame, n: int = 2) -> list[int]:
    """How many word runs of all texts fall into each bucket."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for first, rows, data, offs in bytetext.slices(batch.column(1)):
                total += np.bincount(_runs(data, offs, batch.column(0).slice(first, rows).to_numpy(), n)[1], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = [0] * BUCKETS
    for r in pieces(texts, n).select("owned", "text").mapInArrow(counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains(source: list[int], target: list[int]) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target, with one run more in every bucket."""
    s, t = np.array(source, np.float64), np.array(target, np.float64)
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(texts: DataFrame, gain: np.ndarray, n: int = 2) -> DataFrame:
    """(_rid, n_words, n_features, weight): one row for each row of ``texts`` (_rid, text)."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, data, offs in bytetext.slices(batch.column(2)):
                text, bucket, words = _runs(data, offs, batch.column(1).slice(first, rows).to_numpy(), n)
                total = np.bincount(text, weights=gain[bucket], minlength=rows).astype(np.int64)
                yield pa.record_batch([batch.column(0).slice(first, rows), pa.array(words.astype(np.int64)), pa.array(np.bincount(text, minlength=rows)), pa.array(total)], names=["_rid", "words", "runs", "gain"])

    by_text = pieces(texts, n).mapInArrow(summed, "_rid long, words long, runs long, gain long").groupBy("_rid").agg(F.sum("words").alias("n_words"), F.sum("runs").alias("n_features"), F.sum("gain").alias("gain"))
    # An exact floor: the remainder is taken off before the division.
    mean = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(F.lit(0))
    return by_text.select("_rid", "n_words", "n_features", mean.cast("long").alias("weight"))


def noise(key: Column, seed: int) -> Column:
    """A Gumbel draw in thousandths, fixed by the seed and the key; a null key draws like an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, score: str, tie: list[str], take: int) -> DataFrame:
    """(_rid, rank) of the ``take`` rows with the highest scores, from 1, ties by the columns ``tie``.

    Scores are whole numbers; how many rows each distinct score has is counted
    first, so no task but that of one score sorts rows that it shares with others.
    """
    sizes = rows.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"))
    above = Window.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("s", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("before")).where(F.col("before") < take)
    order = Window.partitionBy("s").orderBy(*(F.asc_nulls_last(c) for c in tie), "_rid")
    placed = rows.withColumnRenamed(score, "s").join(before, "s").select("_rid", (F.col("before") + F.row_number().over(order)).cast("long").alias("rank"))
    return placed.where(F.col("rank") <= take)


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, n: int = 2, seed: int = 7, least_words: int = 20, text: str = "text", key: str = "doc_id", target_text: str = "text") -> DataFrame:
    """(_rid, n_words, n_features, weight, score, rank): one row for each row of docs.

    ``rank`` numbers the drawn documents by score from 1, ties by key (null
    last), then row; others have null. Of the documents with ``least_words``
    words, ``percent`` per cent are drawn, rounded down. docs must be read from
    files. Null and empty texts have no runs, weight 0, and aren't drawn;
    repeated rows draw alike and follow each other; an empty table gives no rows,
    and an empty target leaves all gains to the corpus. Other columns, whatever
    their names, play no part.
    """
    texts = with_row_id(docs.select(F.col(text).alias("text"))).select("_rid", "text")
    wanted = target.select(F.lit(0).cast("long").alias("_rid"), F.col(target_text).alias("text"))
    gain = gains(bucket_counts(texts, n), bucket_counts(wanted, n))
    keys = with_row_id(docs.select(F.col(key).alias("key")))
    scored = stored(weights(texts, gain, n).join(keys, "_rid").withColumn("score", F.col("weight") + noise(F.col("key"), seed)))
    able = scored.where(F.col("n_words") >= least_words)
    drawn = ranked(able.select("_rid", "key", "score"), "score", ["key"], percent * able.count() // 100)
    return scored.join(drawn, "_rid", "left").select("_rid", "n_words", "n_features", "weight", "score", "rank")
