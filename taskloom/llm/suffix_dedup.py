"""Removal of repeated byte strings by prefix-free parsing.

A position is a trigger when its rolling hash is the least of ``REACH``
consecutive ones (leftmost on ties): a bounded form of "hash is 0 modulo p",
so that no phrase is longer than ``REACH`` and every string of ``length`` bytes
holds a trigger at the same place wherever it stands. The triggers cut a text
into phrases. The strings of ``length`` bytes whose first trigger is the same
form a run, and a run with its bytes is a dictionary entry: suffixes of it are
those strings.

The corpus order is needed only as far as ``length`` bytes: suffixes that agree so
far are neighbours in it. It is combined from two parts. The parse gives the right
context from a trigger on; runs whose context occurs once have no equal suffix
anywhere. Of the others, equal dictionary entries are repeated as a whole and are
taken once, with their number of occurrences. An entry that shares its context
with a different one is cut into blocks of ``STEP`` suffixes on a grid that the
trigger fixes; all suffixes of a block hold the same core. Blocks whose core
occurs once are done, equal blocks are repeated as a whole, and only the suffixes
of blocks with one core and different edges are told apart one by one, by the few
bytes of those edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext
from .common import stored, with_row_id

#: Bytes of the rolling hash, and consecutive positions of which one is a trigger.
ROLL, REACH = 16, 144
STEP = 16


def triggers(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, trigger, first start, starts): runs of starts whose strings of ``length`` bytes have the same first trigger."""
    none = np.zeros(0, np.int64)
    sizes = np.diff(offs)
    long_ = np.flatnonzero(sizes >= length)
    if not len(long_):
        return none, none, none, none
    h = bytetext._RANDOM[data]
    for step, by in ((1, 0x9E3779B97F4A7C15), (2, 0xF1BBCDCBFA53E0B5), (4, 0xC2B2AE3D27D4EB4F), (8, 0xD6E8FEB86659FD93)):
        h = h[:-step] * np.uint64(by) + h[step:]
        h ^= h >> np.uint64(29)
    bits = np.uint64(max(23, int(len(data)).bit_length()))
    key = ((bytetext.mix(h) >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
    reach, have = min(REACH, length - ROLL + 1), 1
    least = key
    while have < reach:
        step = min(have, reach - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    counts = sizes[long_] - length + 1
    doc = np.repeat(long_, counts)
    start = np.arange(counts.sum()) + np.repeat(offs[long_] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    at = (least[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], at[first], start[first], np.diff(np.append(first, len(at)))


def _contexts(batches: Iterator[pa.RecordBatch], length: int, entries: bool) -> Iterator[pa.RecordBatch]:
    """The right context of each trigger, hashed; with ``entries``, also the run and its entry."""
    right = length - min(REACH, length - ROLL + 1) + 1
    for batch in batches:
        for at, _, data, offs in bytetext.slices(batch.column(1)):
            doc, trigger, start, n = triggers(data, offs, length)
            if not len(doc):
                continue
            sums = bytetext.prefix_sums(data, bytetext._RANDOM)
            columns = [pa.array(bytetext.span_hash(sums, trigger, trigger + right).view(np.int64))]
            if entries:
                columns += [
                    pa.array(bytetext.span_hash(sums, start, start + n - 1 + length).view(np.int64)),
                    batch.column(0).slice(at).take(pa.array(doc)),
                    pa.array(((start - offs[doc]) << 16) | ((trigger - start) << 8) | n),
                ]
            yield pa.RecordBatch.from_arrays(columns, names=["context", "entry", "_rid", "run"][: len(columns)])


def _blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The wanted entries of a text in blocks: (core, edges, _rid, mark, n, low, high, left, right).

    low to high are the distances back from the grid point to the starts; left
    and right are the bytes that those starts have beside the core.
    """
    for batch in batches:
        wanted, rids = batch.column("wanted").to_pylist(), batch.column("_rid").to_pylist()
        for first, n, data, offs in bytetext.slices(batch.column("text")):
            rows = [(offs[i] + (w["run"] >> 16), (w["run"] >> 8) & 0xFF, w["run"] & 0xFF, w["n"], rids[first + i], offs[i]) for i in range(n) for w in wanted[first + i]]
            if not rows:
                continue
            start, back, count, times, rid, base = (np.array(c, np.int64) for c in zip(*rows))
            lo, hi = back - count + 1, back  # distances from the trigger back to the starts
            cells = hi // STEP - lo // STEP + 1
            e = np.repeat(np.arange(len(rows)), cells)
            cell = lo[e] // STEP + np.arange(len(e)) - np.repeat(np.cumsum(cells) - cells, cells)
            low, high = np.maximum(lo[e] - cell * STEP, 0), np.minimum(hi[e] - cell * STEP, STEP - 1)
            point = (start + back)[e] - cell * STEP
            sums = bytetext.prefix_sums(data, bytetext._RANDOM)
            core = bytetext.mix(bytetext.span_hash(sums, point, point + length - STEP + 1) + cell.astype(np.uint64))
            end = point + length - low
            edges = bytetext.mix(bytetext.span_hash(sums, point - high, end) + (low * STEP + high).astype(np.uint64))
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(core.view(np.int64)), pa.array(edges.view(np.int64)), pa.array(rid[e]), pa.array(((point - high - base[e]) << 16) | (high - low + 1)), pa.array(times[e]),
                    pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)),
                    pa.array([raw[p - h : p] for p, h in zip(point.tolist(), high.tolist())], pa.binary()),
                    pa.array([raw[p + length - STEP + 1 : q] for p, q in zip(point.tolist(), end.tolist())], pa.binary()),
                ],
                names=["core", "edges", "_rid", "mark", "n", "low", "high", "left", "right"],
            )


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, marks in zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist()):
            data = (text or "").encode("utf-8", "surrogatepass")
            spans: list[list[int]] = []
            for m in sorted(marks or ()):
                a, b = m >> 16, (m >> 16) + (m & 0xFFFF) - 1 + length
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            kept = b"".join(data[a:b] for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(data)]))
            out.append((len(data), len(data) - len(kept), len(spans), spans, kept))
        columns = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column("_rid"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.list_(pa.list_(pa.int64()))), pa.array(columns[4], pa.binary())],
            names=["_rid", "n_bytes", "n_removed", "n_spans", "spans", "kept"],
        )


def remove_repeats(docs: DataFrame, length: int = 200, text: str = "text") -> DataFrame:
    """(_rid, n_bytes, n_removed, n_spans, spans, kept): one row per row of docs.

    docs must be read from files. Each byte that a string of ``length`` bytes
    covers goes when that string also starts elsewhere, in the same text or
    another; both occurrences go. Strings do not cross texts and are judged on
    the input. spans are the removed byte ranges, kept the bytes left (which may
    not be whole characters). Null and empty texts have no bytes. Repeated rows
    are separate texts, so both lose what they share. No rows give none. A
    ``length`` below 17 is not supported.
    """
    if length < ROLL + 1:
        raise ValueError(f"length must be {ROLL + 1} at least")
    texts = with_row_id(docs.select(F.col(text).alias("text"))).select("_rid", "text")
    context = texts.mapInArrow(lambda it: _contexts(it, length, False), "context long")
    repeated = context.groupBy("context").agg(F.count("*").alias("n")).where("n > 1").select("context")
    runs = texts.mapInArrow(lambda it: _contexts(it, length, True), "context long, entry long, _rid long, run long")
    runs = stored(runs.join(repeated, "context", "left_semi"))
    entries = runs.groupBy("context", "entry").agg(F.count("*").alias("n"), F.min(F.struct("_rid", "run")).alias("at"))
    entries = stored(entries.select("context", "entry", "n", "at.*"))
    mark = F.shiftleft(F.shiftright("run", 16), 16).bitwiseOR(F.col("run").bitwiseAND(0xFF))
    whole = runs.join(entries.where("n > 1").select("context", "entry"), ["context", "entry"], "left_semi").select("_rid", mark.alias("mark"))
    # A context with one entry has nothing left to tell apart.
    mixed = entries.groupBy("context").agg(F.count("*").alias("entries")).where("entries > 1").select("context")
    wanted = entries.join(mixed, "context", "left_semi").groupBy("_rid").agg(F.collect_list(F.struct("run", "n")).alias("wanted"))
    # Nothing is stored between here and the end: both joins with the texts then read one shuffle of them.
    blocks = texts.join(wanted, "_rid").mapInArrow(lambda it: _blocks(it, length), "core long, edges long, _rid long, mark long, n long, low int, high int, left binary, right binary")
    cores = blocks.groupBy("core").agg(F.sum("n").alias("total"), (F.min("edges") == F.max("edges")).alias("alike")).where("total > 1").select("core", "alike")
    open_ = blocks.join(cores, "core")
    alike = open_.where("alike and n = 1").select("_rid", "mark")
    edge = F.struct(F.expr("substring(left, length(left) - d + 1, d)").alias("l"), F.expr(f"substring(right, 1, {STEP - 1} - d)").alias("r"))
    # The mark holds the farthest start; the one at distance d comes high - d later.
    suffixes = open_.where("not alike").select("core", "_rid", "n", "mark", "high", "left", "right", F.explode(F.sequence("low", "high")).alias("d"))
    suffixes = suffixes.select("core", "d", F.xxhash64("core", "d", edge).alias("suffix"), "_rid", "n", (F.shiftleft(F.shiftright("mark", 16) + F.col("high") - F.col("d"), 16) + 1).alias("mark"))
    equal = suffixes.groupBy("core", "suffix").agg(F.sum("n").alias("total")).where("total > 1").select("core", "suffix")
    single = suffixes.where("n = 1").join(equal, ["core", "suffix"], "left_semi").select("_rid", "mark")
    marks = whole.union(alike).union(single).groupBy("_rid").agg(F.collect_list("mark").alias("marks"))
    cut = texts.join(marks, "_rid", "left").mapInArrow(lambda it: _cut(it, length), "_rid long, n_bytes long, n_removed long, n_spans long, spans array<array<long>>, kept binary")
    return cut
