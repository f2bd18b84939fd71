"""Alignment, resampling and top-k search against brute force, and the cases without content."""

import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from math import floor, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from taskloom.llm import align, decontaminate, resample, topk, url_filter
from taskloom.llm.queries import TOKENIZERS

A_FILE, B_FILE = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
#: Columns whose names the operators use inside, too.
SCHEMA = "doc_id long, text string, _rid string, rank int, part string, key string, weight double"


def written(spark, path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(path))
    return spark.read.parquet(str(path))


def texts():
    rng = random.Random(5)
    words = ["the", "a", "Ünïcode", "ﬁn", "naïve", "日本語", "🙂🙂", "don't", "x" * 70, "<|endoftext|>", "<s>", "▁", " ", "12345", "\r\n", "tokenization", "  ", "\t\t", "é"]
    made = ["".join(rng.choice(words) + rng.choice([" ", "", "\n", "  "]) for _ in range(rng.randint(1, 120))) for _ in range(40)]
    return [None, "", " ", "a", "\u0000b", *made, made[0], made[0], "word " * 9000, "z" * 20000]


def as_docs(spark, path, all_texts):
    return written(spark, path, [(i if i != 7 else None, t, "x", 1, "p", "k", 0.5) for i, t in enumerate(all_texts)])


def aligned_plainly(all_texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    letters = align._byte_names()
    docs, holds = [], defaultdict(set)
    for d, text in enumerate(all_texts):
        doc, said = ([], [], []), (" " + (text or "")).encode()
        if text:
            left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
            if b"".join(x for _, x in left) == said == b"".join(x for _, x in right):
                groups, links, i, j, at_a, at_b, pa, pb = [], [], 0, 0, 0, 0, [], []
                while i < len(left) or j < len(right):
                    if at_a <= at_b and i < len(left) and (at_a < at_b or not pa):
                        pa.append(left[i][0])
                        at_a, i = at_a + len(left[i][1]), i + 1
                    else:
                        pb.append(right[j][0])
                        at_b, j = at_b + len(right[j][1]), j + 1
                    if at_a == at_b and pa and pb:
                        groups.append((pa, pb))
                        pa, pb = [], []
                spans_a, spans_b = (np.cumsum([0] + [len(x) for _, x in side]) for side in (left, right))
                for k, (x, _) in enumerate(left):
                    lo = int(np.searchsorted(spans_b, spans_a[k], "right")) - 1
                    while lo < len(right) and spans_b[lo] < spans_a[k + 1]:
                        links.append((x, right[lo][0]))
                        lo += 1
                doc = (left, right, groups, links)
                for link in set(links):
                    holds[link].add(d)
        docs.append(doc if len(doc) == 4 else ([], [], [], []))
    count = {k: len(v) for k, v in holds.items()}
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    rows = []
    for left, right, groups, links in docs:
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((len(left), len(right), len(groups), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), sha256(line.encode()).hexdigest() if line else ""))
    return rows, count


@pytest.mark.parametrize("part", [4_000_000, 300])
def test_alignment(spark, tmp_path, monkeypatch, part):
    all_texts = texts()
    docs = as_docs(spark, tmp_path / "d", all_texts)
    taken = align._aligned

    def small(batches, a, b):
        align.PART = part
        return taken(batches, a, b)

    monkeypatch.setattr(align, "_aligned", small)
    found, pairs = align.align(docs, A_FILE, B_FILE)
    want, count = aligned_plainly(all_texts)
    assert sorted(tuple(r)[1:] for r in found.collect()) == sorted(want)
    assert {(r.a, r.b): r.docs for r in pairs.collect()} == count


def resampled_plainly(rows, target, percent=25, n=2):
    def runs(text):
        w = decontaminate.word_pattern().findall((text or "").translate(str.maketrans(decontaminate.UPPER, decontaminate.LOWER)))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    s, t = (Counter(b for text in side for b in runs(text)[1]) for side in ([r[1] for r in rows], target))
    ss, tt = sum(s.values()), sum(t.values())
    out = []
    for key, text in rows:
        words, found = runs(text)
        gain = sum(floor(1000 * log((t[b] + 1.0) * (ss + 10_000.0) / ((s[b] + 1.0) * (tt + 10_000.0)))) for b in found)
        weight = gain // len(found) if found else 0
        h = int(sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, words, len(found), weight, weight + floor(-1000 * log(-log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    taken = able[: percent * len(able) // 100]
    return sorted(((*r, next((k for k, x in enumerate(taken, 1) if x is r), None)) for r in out), key=str)


@pytest.mark.parametrize("long_, chunk", [(1 << 15, 4096), (200, 7)])
def test_resampling(spark, tmp_path, monkeypatch, long_, chunk):
    monkeypatch.setattr(resample, "LONG", long_)
    taken = resample._split

    def small(batches, n):
        resample.CHUNK_WORDS = chunk
        return taken(batches, n)

    monkeypatch.setattr(resample, "_split", small)
    all_texts = [*texts(), "q" * 100 + " r " + "Q" * 100, "!" * 500, *(f"Word{i} tail Ä ä {'lorem ' * (i % 40)}" for i in range(60))]
    docs = as_docs(spark, tmp_path / "d", all_texts)
    target = spark.createDataFrame([("word1 tail lorem lorem naïve",), (None,), ("",), ("the a",)], "text string")
    for n in (1, 2, 3):
        got = resample.resample(docs, target, n=n)
        rows = docs.select("doc_id", "text").collect()
        named = resample.with_row_id(docs.select("doc_id")).join(got, "_rid").select("doc_id", "n_words", "n_features", "weight", "score", "rank")
        assert sorted((tuple(r) for r in named.collect()), key=str) == resampled_plainly([tuple(r) for r in rows], ["word1 tail lorem lorem naïve", None, "", "the a"], n=n)


def test_ranks_of_ties(spark):
    rows = spark.createDataFrame([(i, i % 3, 5 - i // 10, i) for i in range(40)], "_rid long, tie long, score long, x int")
    want = [r[0] for r in sorted(((i, i % 3, 5 - i // 10) for i in range(40)), key=lambda r: (-r[2], r[1], r[0]))][:17]
    assert [r._rid for r in resample.ranked(rows.drop("x"), "score", ["tie"], 17).orderBy("rank").collect()] == want


VECTORS = "vec_id long, embedding array<float>, label int, rid string, q int, score string"


def vectors():
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(12, 16)) / 4
    made = [[float(x) for x in np.float32(centre[i % 12] + rng.normal(size=16) * 0.02)] for i in range(400)]
    made += [made[0]] * 30 + [[0.0] * 16, None, [], [1.0, None] + [0.0] * 14, [float("nan")] + [0.0] * 15, [float("inf")] + [0.0] * 15, [1.0, -2.0], [0.5, 0.25], [], [float(np.float32(3e12))] + [1.0] * 15]
    return [(i, v, 1, "r", 2, "s") for i, v in enumerate(made)] + [(None, made[1], 1, "r", 2, "s"), (10, made[2], 1, "r", 2, "s"), (10, made[2], 1, "r", 2, "s")]


def top_plainly(rows, k, asks):
    able = [(n, i, [floor(256 * float(x)) for x in v]) for n, (i, v, *_) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, i, q in able:
        if i is not None and asks(i):
            found = sorted((-sum(a * b for a, b in zip(q, v)), j is None, j or 0) for m, j, v in able if m != n and len(v) == len(q))
            out += [(i, r, None if none else j, -s) for r, (s, none, j) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("bits, block, at_once", [(6, 1 << 20, 512), (1, 2000, 7), (8, 1 << 20, 1)])
def test_top_k(spark, tmp_path, monkeypatch, bits, block, at_once):
    monkeypatch.setattr(topk, "BLOCK_BYTES", block)
    rows = vectors()
    if bits == 8:  # slow by steps of one, so few vectors
        rows = rows[::3]
    table = written(spark, tmp_path / "v", rows, VECTORS)
    got = topk.top_k(table, F.col("vec_id") % 10 == 0, k=3, bits=bits)
    assert sorted((tuple(r) for r in got.collect()), key=str) == top_plainly(rows, 3, lambda i: i % 10 == 0)


def test_empty_tables(spark, tmp_path):
    docs, none = written(spark, tmp_path / "e", []), written(spark, tmp_path / "f", [], VECTORS)
    assert [x.count() for x in align.align(docs, A_FILE, B_FILE)] == [0, 0]
    assert resample.resample(docs, docs).count() == 0
    assert topk.top_k(none, F.col("vec_id") % 10 == 0).count() == 0
    some = written(spark, tmp_path / "g", [(1, "one two three " * 9, "", 1, "", "", 0.0)])
    assert resample.resample(some, docs).select("n_features", "rank").collect() == [(53, None)]


def test_rules_of_many_overlapping_keys(spark):
    """The rules of 8 keys are those of a naive miner; 20 keys on 1,000 URLs end, too."""
    rng = random.Random(8)

    def labelled(keys, n=1000):
        rows = []
        for _ in range(n):
            mine = [k for k in range(keys) if rng.random() < 0.5]
            rows.append(("http://a.b/?" + "&".join(f"k{k}" for k in mine), rng.random() < 0.3 + 0.4 * (1 in mine and 2 in mine) + 0.2 * (3 in mine)))
        return rows

    rows = labelled(8)
    got = {tuple(r.rule): (round(r.confidence, 9), round(r.support, 9)) for r in url_filter.mine_rules(spark.createDataFrame(rows, "url string, block boolean")).collect()}
    good, base = {}, sum(b for _, b in rows) / len(rows)
    sets = [(frozenset(x for x in url.partition("?")[2].split("&") if x), b) for url, b in rows]
    for mask in range(1, 256):
        want = frozenset(f"k{k}" for k in range(8) if mask >> k & 1)
        held = [b for s, b in sets if want <= s]
        if sum(held) >= 20 and sum(held) / len(held) >= max(0.5, 1.2 * base):
            good[want] = (sum(held) / len(held), sum(held) / len(rows))
    kept = {r: v for r, v in good.items() if not any(s < r and good[s][0] >= v[0] for s in good)}
    assert kept and got == {tuple(sorted(f"q:{k}" for k in r)): (round(c, 9), round(s, 9)) for r, (c, s) in kept.items()}
    assert url_filter.mine_rules(spark.createDataFrame(labelled(20), "url string, block boolean")).where("size(rule) = 2").count() > 0
