"""Alignment of two tokenizers over the same bytes, by a dictionary of token groups.

Tokenizer A is a byte-level BPE over a space and the text, tokenizer B a
sentence-piece BPE over the text. Byte offsets where tokens of both end cut the
tokens into groups; the same groups return again and again. Each part of the
texts is tokenized once and interns its distinct groups; over all parts the
distinct groups are expanded to their links once, counts of documents are summed
by id pair, and what a group is worth goes back to the parts by the group's key,
from there to the documents that hold it.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytetext
from .common import stored, with_row_id

#: Bytes of text tokenized at once, except that one text is never cut.
PART = 4_000_000
#: Fixed value: how byte-level vocabularies split text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_names() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte: its own where that prints, else the next from 256 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173]
    others = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}


@functools.lru_cache(maxsize=2)
def tokenizers(a_file: str, b_file: str) -> tuple[Callable, Callable, list[bytes], list[bytes]]:
    """(encode A, encode B, bytes of A's ids, bytes of B's ids), loaded once a process."""
    import sentencepiece
    import tiktoken

    name, vocabulary = _byte_names(), json.load(open(a_file, encoding="utf-8"))["model"]["vocab"]
    ranks = {bytes(name[c] for c in entry): i for entry, i in vocabulary.items() if all(c in name for c in entry)}
    # An id is the rank of its merge in such a vocabulary.
    a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    a_bytes = [b""] * (max(ranks.values()) + 1)
    for entry, i in ranks.items():
        a_bytes[i] = entry
    b = sentencepiece.SentencePieceProcessor(model_file=b_file)
    b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]
    return a.encode_ordinary, functools.partial(b.encode, num_threads=1), a_bytes, b_bytes


def _links(p: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, A id, B id) of every overlap; group i is the next p[i] ids of a and q[i] of b."""
    a_end, b_end = np.cumsum(a_size[a]), np.cumsum(b_size[b])
    # Groups end together, so an overlap begins where one token or the other does.
    starts = np.union1d(a_end - a_size[a], b_end - b_size[b])
    i, j = np.searchsorted(a_end, starts, "right"), np.searchsorted(b_end, starts, "right")
    return np.repeat(np.arange(len(p)), p)[i], a[i], b[j]


def _spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of the given lengths."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _interned(p: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, first): equal groups have equal codes, and where each code first stands."""
    group_a, group_b, at_a, at_b = np.repeat(np.arange(len(p)), p), np.repeat(np.arange(len(q)), q), np.cumsum(p) - p, np.cumsum(q) - q
    place_a, place_b = _spread(p), _spread(q)
    for salt in range(1, 9):
        h = np.zeros(len(p), np.uint64)
        for group, ids, place, side in ((at_a, a, place_a, 0), (at_b, b, place_b, 1)):
            mixed = bytetext.mix((ids.astype(np.uint64) << np.uint64(32)) + (place.astype(np.uint64) << np.uint64(4)) + np.uint64(2 * salt + side))
            h = h * np.uint64(31) + np.add.reduceat(mixed, group)
        code = pd.factorize(h)[0]
        first = np.full(int(code.max()) + 1, len(code))
        first[code[::-1]] = np.arange(len(code))[::-1]
        like = first[code]  # held against the tokens themselves
        same = (p[like] == p).all() and (q[like] == q).all()
        if same and (a[at_a[like][group_a] + place_a] == a).all() and (b[at_b[like][group_b] + place_b] == b).all():
            return code, first
    raise RuntimeError("groups could not be told apart by hashes")


_MADE = "kind string, _rid long, part long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, held array<int>, times array<int>, at int, group string, a int, b int, docs long"
_NAMES = [c.split()[0] for c in _MADE.split(", ")]
_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32())}
_TYPES = [_TYPES[c.split()[1]] for c in _MADE.split(", ")]


def _rows(n: int, **columns) -> pa.RecordBatch:
    return pa.record_batch([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(_NAMES, _TYPES)], names=_NAMES)


def _part(rids: list[int], texts: list[str | None], a_file: str, b_file: str) -> Iterator[pa.RecordBatch]:
    """The documents of one part, its distinct groups, and the documents that hold each id pair."""
    encode_a, encode_b, a_bytes, b_bytes = tokenizers(a_file, b_file)
    a_size, b_size = (np.array([len(x) for x in names], np.int64) for names in (a_bytes, b_bytes))
    ids_a, ids_b, none = [], [], np.zeros(0, np.int32)
    for text in texts:
        x = y = none
        if text:
            left, right, said = encode_a(" " + text), encode_b(text), (" " + text).encode()
            if b"".join(map(a_bytes.__getitem__, left)) == said and b"".join(map(b_bytes.__getitem__, right)) == said:
                x, y = np.array(left, np.int32), np.array(right, np.int32)
        ids_a.append(x)
        ids_b.append(y)
    n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
    n, a, b = len(rids), np.concatenate([none, *ids_a]), np.concatenate([none, *ids_b])
    if not len(a):
        yield _rows(n, kind=["doc"] * n, _rid=rids, part=[rids[0]] * n, n_a=n_a, n_b=n_b, n_groups=n_a, n_links=n_a, groups_sha256=[""] * n, held=[[]] * n, times=[[]] * n)
        return
    a_end, b_end = np.cumsum(a_size[a]), np.cumsum(b_size[b])
    ends = np.zeros(int(a_end[-1]) + 1, bool)
    ends[a_end] = True
    cut_b = np.flatnonzero(ends[b_end])
    ends[:] = False
    ends[b_end] = True
    cut_a = np.flatnonzero(ends[a_end])
    p, q = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
    code, first = _interned(p, q, a, b)
    doc_of = np.searchsorted(np.cumsum(n_a), cut_a, "right")
    n_groups = np.bincount(doc_of, minlength=n)
    # The dictionary of the part: a line of text and the links for each distinct group, made once.
    at_a, at_b = (np.cumsum(p) - p)[first], (np.cumsum(q) - q)[first]
    lines = np.array([",".join(map(str, a[i : i + u])) + "|" + ",".join(map(str, b[j : j + v])) for i, u, j, v in zip(at_a.tolist(), p[first].tolist(), at_b.tolist(), q[first].tolist())], object)
    own_a, own_b = np.repeat(at_a, p[first]) + _spread(p[first]), np.repeat(at_b, q[first]) + _spread(q[first])
    of_group, link_a, link_b = _links(p[first], q[first], a[own_a], b[own_b], a_size, b_size)
    pair, pairs = pd.factorize((link_a.astype(np.int64) << 32) | link_b)
    # Distinct groups by document, then distinct pairs by document.
    held, of_held = np.unique(doc_of.astype(np.int64) * len(first) + code, return_counts=True)
    held_doc, held_code = held // len(first), held % len(first)
    n_of = np.bincount(of_group, minlength=len(first))
    its = (np.cumsum(n_of) - n_of)[held_code]
    in_doc = pd.unique(np.repeat(held_doc, n_of[held_code]) * len(pairs) + pair[np.repeat(its, n_of[held_code]) + _spread(n_of[held_code])])
    docs = np.bincount(in_doc % len(pairs), minlength=len(pairs))
    names, at = lines[code], np.concatenate([[0], np.cumsum(n_groups)])
    sha = [hashlib.sha256(";".join(names[at[i] : at[i + 1]]).encode()).hexdigest() if n_groups[i] else "" for i in range(n)]
    border = pa.array(np.searchsorted(held_doc, np.arange(n + 1)), pa.int32())
    lists = (pa.ListArray.from_arrays(border, pa.array(x.astype(np.int32))) for x in (held_code, of_held))
    part = rids[0]
    yield _rows(n, kind=["doc"] * n, _rid=rids, part=[part] * n, n_a=n_a, n_b=n_b, n_groups=n_groups, n_links=n_a + n_b - n_groups, groups_sha256=sha, held=next(lists), times=next(lists))
    for k in range(0, len(first), 100_000):
        some = lines[k : k + 100_000]
        yield _rows(len(some), kind=["group"] * len(some), part=[part] * len(some), at=np.arange(k, k + len(some)), group=some)
    yield _rows(len(pairs), kind=["pair"] * len(pairs), a=pairs >> 32, b=pairs & 0xFFFFFFFF, docs=docs)


def _aligned(batches: Iterator[pa.RecordBatch], a_file: str, b_file: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = np.cumsum(np.diff(_offsets(batch.column(1))))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PART, "right")))
            yield from _part(batch.column(0)[at:to].to_pylist(), batch.column(1)[at:to].to_pylist(), a_file, b_file)
            at = to


def _offsets(column: pa.Array) -> np.ndarray:
    lengths = column.cast(pa.large_string())
    return np.frombuffer(lengths.buffers()[1], np.int64, len(lengths) + 1 + lengths.offset)[lengths.offset :]


def _expanded(batches: Iterator[pa.RecordBatch], a_file: str, b_file: str) -> Iterator[pa.RecordBatch]:
    """(group, a, b, times): the links of each distinct group."""
    _, _, a_bytes, b_bytes = tokenizers(a_file, b_file)
    a_size, b_size = (np.array([len(x) for x in names], np.int64) for names in (a_bytes, b_bytes))
    for batch in batches:
        lines = batch.column(0).to_pylist()
        sides = [[np.array(side.split(","), np.int32) for side in line.split("|")] for line in lines]
        if lines:
            p, q = (np.array([len(s[i]) for s in sides]) for i in (0, 1))
            group, a, b = _links(p, q, *(np.concatenate([s[i] for s in sides]) for i in (0, 1)), a_size, b_size)
            found = pd.DataFrame({"g": group, "a": a, "b": b}).value_counts(sort=False).reset_index(name="n")
            yield pa.record_batch([batch.column(0).take(pa.array(found.g.to_numpy())), pa.array(found.a.to_numpy(np.int32)), pa.array(found.b.to_numpy(np.int32)), pa.array(found.n.to_numpy(np.int64))], names=["group", "a", "b", "times"])


def _summed(docs: pa.Table, worth: pa.Table) -> pa.Table:
    """The sums over the groups of each document of one part."""
    at = worth["at"].to_numpy()
    value = np.zeros((2, int(at.max(initial=0)) + 1), np.int64)
    value[0, at], value[1, at] = worth["n_best"].to_numpy(), worth["count_sum"].to_numpy()
    held, times = (pa.concat_arrays([pa.array([], pa.list_(pa.int32())), *docs[c].cast(pa.list_(pa.int32())).chunks]) for c in ("held", "times"))
    count = held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.zeros((2, int(count.sum()) + 1), np.int64)
    np.cumsum(value[:, held.flatten().to_numpy()] * times.flatten().to_numpy(), axis=1, out=total[:, 1:])
    stop = np.cumsum(count)
    best, sums = total[:, stop] - total[:, stop - count]
    return docs.select(["_rid", "n_a", "n_b", "n_groups", "n_links"]).append_column("n_best", pa.array(best)).append_column("count_sum", pa.array(sums)).append_column("groups_sha256", docs["groups_sha256"])


def align(docs: DataFrame, a_file: str, b_file: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((_rid, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), (a, b, docs, best)).

    The first has one row for each row of docs, the second every linked id pair
    with the number of documents that hold it, and whether no pair of its A id
    has more. docs must be read from files; executors must find both tokenizer
    files at their paths. Null and empty texts, and those that a tokenizer does
    not give back byte by byte, have no tokens: zeros and ''. Repeated rows are
    separate documents; an empty table gives no rows. A text is tokenized whole,
    however long, in memory of about 100 bytes for each of its tokens. Other
    columns of docs, whatever their names, play no part.
    """
    texts = with_row_id(docs.select(F.col(text).alias("text"))).select("_rid", "text")
    made = stored(texts.mapInArrow(lambda it: _aligned(it, a_file, b_file), _MADE))
    counts = made.where("kind = 'pair'").groupBy("a", "b").agg(F.sum("docs").alias("docs"))
    pairs = stored(counts.withColumn("best", F.col("docs") == F.max("docs").over(Window.partitionBy("a"))))
    parts = made.where("kind = 'group'").select("part", "at", "group")
    links = parts.select("group").distinct().mapInArrow(lambda it: _expanded(it, a_file, b_file), "group string, a int, b int, times long")
    worth = links.join(pairs, ["a", "b"]).groupBy("group").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    back = parts.join(worth, "group").select("part", "at", "n_best", "count_sum")
    rows = made.where("kind = 'doc'").select(F.col("part").alias("unit"), "_rid", "n_a", "n_b", "n_groups", "n_links", "held", "times", "groups_sha256")
    out = rows.groupBy("unit").cogroup(back.groupBy("part")).applyInArrow(_summed, "_rid long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out, pairs
