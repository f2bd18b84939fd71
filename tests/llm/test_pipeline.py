import re
from collections import Counter, defaultdict

import corpus_pipeline
from taskloom.llm.decontaminate import LOWER, UPPER, word_pattern
from taskloom.llm.queries import quality_scores

SF = "/root/testdata/sf0.001"


def words(text, lowered=str.lower):
    return word_pattern().findall(lowered(text or ""))


def plain_quality(spark, docs, rows):
    scores = {r.doc_id: r.score for r in quality_scores(spark, docs, SF).collect()}
    return {d: t for d, t in rows.items() if scores[d] >= 0.3}


def plain_lines(spark, docs, rows):
    """Every line against every line before it that shares a word, those that went included."""
    before, by_word, out = [], defaultdict(set), {}
    for d, text in sorted(rows.items()):
        kept = []
        for line in [] if text is None else text.split("\n"):
            w = {x for x in re.sub(r"[\t\v\f\r]", " ", line).lower().split(" ") if x}
            near = {i for x in w for i in by_word[x] if 4 * max(len(before[i]), len(w)) <= 5 * min(len(before[i]), len(w))}
            if not w or not any(9 * len(before[i] & w) >= 4 * (len(before[i]) + len(w)) for i in near):
                kept.append(line)
            if w:
                for x in w:
                    by_word[x].add(len(before))
                before.append(w)
        out[d] = None if text is None else "\n".join(kept)
    return out


def plain_near(spark, docs, rows):
    """Weighted Jaccard of all pairs that share five words; the least id of what hangs together stays."""
    bags, holders = {}, defaultdict(set)
    for d, text in rows.items():
        w = words(text)
        bags[d] = Counter(" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter()
        for g in bags[d]:
            holders[g].add(d)
    root = {d: d for d in rows}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, bag in bags.items():
        for b in {x for g in bag for x in holders[g] if x > a}:
            shared = sum((bag & bags[b]).values())
            if shared >= 0.8 * (sum(bag.values()) + sum(bags[b].values()) - shared):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d: t for d, t in rows.items() if top(d) == d}


def plain_clean(spark, docs, rows):
    table = str.maketrans(UPPER, LOWER)
    fold = lambda t: t.translate(table)
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text, fold)
        for i in range(max(len(w) - 9, 1) if w else 0):
            windows[len(w[i : i + 10])].add(tuple(w[i : i + 10]))
    out = {}
    for d, text in rows.items():
        w = words(text, fold)
        if not any(tuple(w[i : i + n]) in some for n, some in windows.items() for i in range(len(w) - n + 1)):
            out[d] = text
    return out


PLAIN = [plain_quality, plain_lines, plain_near, plain_clean]


def test_stages(spark, tmp_path):
    """Each stage but the last against a plain version of it, on what the stage before it kept; the mix by its promises."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        assert len(rows) == before, "ids tell the rows apart"
        want = PLAIN[k](spark, docs, rows) if k < len(PLAIN) else None
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert set(columns) <= set(docs.columns), name
        after = docs.count()
        assert 0 < after <= before, name
        if want is not None:
            assert {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()} == want, name
        before = after
    assert docs.where("copies < 1 or copies > 3").count() == 0
    mixed = {r.doc_id: (r["size"], r.copies) for r in docs.collect()}
    assert all(r == len(re.findall(r"[^\x20\x09-\x0D]+", rows[d] or "")) for d, (r, _) in mixed.items())
    again = corpus_pipeline.STAGES[-1][1](spark, spark.read.parquet(str(tmp_path / "3")), SF)
    assert {r.doc_id: (r["size"], r.copies) for r in again.collect()} == mixed
