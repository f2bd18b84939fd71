"""Operators against brute force on small fixtures, and the cases without content."""

import collections
import math
import random
import re
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from taskloom.llm import chat, decontaminate, line_dedup, mixture, near_dedup, quality, substring_dedup, suffix_dedup, url_filter, vector_dedup
from taskloom.llm.common import table, with_row_id
from taskloom.llm.queries import ORACLES, QUERIES
from taskloom.llm.vector_dedup import near_vectors

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, _rid string"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """Nulls, empty and long texts, ties, repeated rows, and a column that clashes with an inner name."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "nd."]
    base = [" ".join(rng.choice(vocabulary) + ("\n" if rng.random() < 0.05 else "") for _ in range(rng.randint(1, 260))) for _ in range(40)]
    near = [re.sub(r"w7\b", "x", b) for b in base[:12]]
    rows = [(i, t, "x") for i, t in enumerate(base + near + base[:6])] + [(200, None, None), (201, "", ""), (202, "abc " * 3000, ""), (None, base[0], "n"), (5, base[5], "x"), (5, base[5], "x")]
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def none(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "e"))
    return spark.read.parquet(str(tmp_path / "e"))


def plain(docs):
    return docs.drop("_rid")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.execute(ORACLES[name]).df(), QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    # Whole numbers with nulls are floats on one side and nullable integers on the other.
    a, b = (d[columns].convert_dtypes().astype(str).sort_values(columns).reset_index(drop=True) for d in (want, got))
    assert a.equals(b)


def test_row_ids_do_not_depend_on_splits(spark, docs):
    ids = []
    for most in ("128m", "1k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        try:
            whole = with_row_id(docs.drop("_rid")).collect()
            part = with_row_id(docs.select(docs.doc_id.alias("k"), docs.text)).where("k > 3").select("_rid", "k").collect()
            ids.append((sorted(whole, key=str), sorted(part), sorted(r._rid for r in with_row_id(table(spark, SF, "documents").select("doc_id")).collect())))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ids[0] == ids[1]
    assert len({r._rid for r in ids[0][0]}) == len(ids[0][0]) == docs.count()
    assert {r._rid for r in ids[0][1]} <= {r._rid for r in ids[0][0]} and min(r._rid for r in ids[0][0]) >= 0


def test_suffix(docs):
    rows = docs.select("text").collect()
    data = [(r.text or "").encode() for r in rows]
    count = collections.Counter(d[s : s + 50] for d in data for s in range(len(d) - 49))
    want = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for s in range(len(d) - 49):
            if count[d[s : s + 50]] > 1:
                gone[s : s + 50] = True
        want.append((len(d), int(gone.sum()), sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()))
    got = [(r.n_bytes, r.n_removed, sha256(r.kept).hexdigest()) for r in suffix_dedup.remove_repeats(plain(docs), 50).collect()]
    assert sorted(got) == sorted(want)


def late_lines(rows):
    """(row, line) of every line that one before it resembles; rows are (key, text), in order."""
    lines = [(k, i, frozenset(line.lower().split())) for k, (_, t) in enumerate(rows) if t is not None for i, line in enumerate(t.split("\n"))]
    return {(k, i) for at, (k, i, w) in enumerate(lines) if w and any(len(w & v) >= 0.8 * len(w | v) - 1e-9 for _, _, v in lines[:at] if v)}


@pytest.mark.parametrize("sent", [line_dedup.SENT, 0])
def test_lines(docs, monkeypatch, sent):
    monkeypatch.setattr(line_dedup, "SENT", sent)
    numbered = with_row_id(docs.select("doc_id", "text")).collect()
    rows = sorted(numbered, key=lambda r: (r.doc_id is None, r.doc_id or 0, r._rid))
    want = {(rows[k]._rid, i) for k, i in late_lines([(r.doc_id, r.text) for r in rows])}
    assert {tuple(r) for r in line_dedup.removed_lines(plain(docs)).collect()} == want
    out = line_dedup.line_dedup(docs)
    assert out.columns == [*docs.columns, "removed_lines"]
    gone = {k: {i for x, i in want if x == k} for k, _ in want}
    text = {r._rid: (None if r.text is None else "\n".join(s for i, s in enumerate(r.text.split("\n")) if i not in gone.get(r._rid, ()))) for r in rows}
    others = {r._rid: o for r, o in zip(with_row_id(docs.select("doc_id", "text")).collect(), [r["_rid"] for r in docs.collect()])}
    assert sorted(map(str, [(r.doc_id, r.text, r["_rid"]) for r in out.collect()])) == sorted(str((r.doc_id, text[r._rid], others[r._rid])) for r in rows)


def test_line_links(docs):
    """All links, not one witness a line: counts, components and removed lines by plain Python."""
    rows = sorted(with_row_id(docs.select("doc_id", "text")).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r._rid))
    lines = [(r._rid, i, frozenset(line.lower().split())) for r in rows if r.text is not None for i, line in enumerate(r.text.split("\n"))]
    lines = [x for x in lines if x[2]]
    links, root = collections.Counter(), {r: r for r, _, _ in lines}
    for at, (r, i, w) in enumerate(lines):
        for s, _, v in lines[:at]:
            if len(w & v) >= 0.8 * len(w | v) - 1e-9:
                links[r] += 1
                links[s] += 1
                old, new = max(root[r], root[s]), min(root[r], root[s])
                root = {k: new if x == old else x for k, x in root.items()}
    gone = late_lines([(r.doc_id, r.text) for r in rows])
    removed = collections.defaultdict(list)
    for k, i in sorted(gone):
        removed[rows[k]._rid].append(i)
    got = {r._rid: (r.removed, r.n_links, r.component) for r in line_dedup.line_links(plain(docs)).collect()}
    assert got == {r: (removed[r], links[r], root[r]) for r in root}


def test_links_within_families(spark, tmp_path, monkeypatch):
    """Groups of near copies with one to nine words edited: all links count, and not all are verified one by one."""
    monkeypatch.setattr(line_dedup, "FAMILY", 8)
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdefgh", k=5))
    groups = [[word() for _ in range(n)] for n in (9, 40, 60)]

    def edited(words):
        out = list(words)
        for _ in range(draw.choice([0, 1, 1, 2, 3, 9])):
            at = draw.randrange(len(out))
            out[at : at + 1] = draw.choice([[], [word()], [out[at], word()]])
        return " ".join(out)

    texts = ["\n".join([edited(draw.choice(groups)), " ".join(word() for _ in range(8))][: draw.choice([1, 1, 2])]) for _ in range(150)]
    spark.createDataFrame([(k // 2, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    rows = sorted(with_row_id(docs).collect(), key=lambda r: (r.doc_id, r._rid))
    lines = [(r.doc_id, r._rid, i, frozenset(s.split())) for r in rows for i, s in enumerate(r.text.split("\n"))]
    first = {}
    for *place, w in lines:
        first.setdefault(w, tuple(place))
    sets = list(first)
    want = {(first[a], first[b]) for k, a in enumerate(sets) for b in sets[k + 1 :] if len(a & b) >= 0.8 * len(a | b) - 1e-9}
    members, links = line_dedup.similar_lines(docs)
    got = [(tuple(r.one), tuple(r.two)) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    rest = line_dedup._similar(docs, 0.8, "text", "doc_id")[1].count()
    assert rest < len(want)
    alike, root = collections.Counter(), {r._rid: r._rid for r in rows}
    gone = collections.defaultdict(set)
    for k, (_, r, i, w) in enumerate(lines):
        for _, s, j, v in lines[:k]:
            if len(w & v) >= 0.8 * len(w | v) - 1e-9:
                alike[r] += 1
                alike[s] += 1
                gone[r].add(i)
                old, new = max(root[r], root[s]), min(root[r], root[s])
                root = {x: new if y == old else y for x, y in root.items()}
    found = {r._rid: (r.removed, r.n_links, r.component) for r in line_dedup.line_links(docs).collect()}
    assert found == {r: (sorted(gone[r]), alike[r], root[r]) for r in root}


@pytest.mark.parametrize("rarity", [False, True])
def test_near_groups(docs, rarity):
    rows = docs.select("doc_id", "text").collect()
    sets = []
    for r in rows:
        w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (r.text or "").lower())
        sets.append(collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else {})
    n, held = sum(map(bool, sets)), collections.Counter(x for s in sets for x in s)
    sets = [{x: c * (np.log1p(n / held[x]) if rarity else 1) for x, c in s.items()} for s in sets]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = sum(min(w, sets[j].get(x, 0)) for x, w in sets[i].items())
            if both and both >= 0.8 * (sum(sets[i].values()) + sum(sets[j].values()) - both):
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    got = near_dedup.near_groups(plain(docs), rarity=rarity).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(set(root))
    groups: dict[int, list] = collections.defaultdict(list)
    for r, c in zip(rows, root):
        groups[c].append(r.doc_id)
    least = {c: min((x for x in g if x is not None), default=None) for c, g in groups.items()}
    assert collections.Counter((r.doc_id, r.group_id, r.group_size) for r in got) == collections.Counter((r.doc_id, least[c], len(groups[c])) for r, c in zip(rows, root))


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    for a, b in ((np.ones(400), np.ones(400)), (rng.exponential(3.0, 400), rng.exponential(3.0, 400)), (rng.integers(1, 30, 400) * 1.0, np.full(400, 7.5))):
        element = np.concatenate([np.arange(400), np.arange(80, 480)]).astype(np.uint64)
        sig = near_dedup.dart_signatures(np.repeat([0, 1], 400), element, np.concatenate([a, b]), 2, 4000)
        both = np.minimum(a[80:], b[:320]).sum()
        assert abs((sig[0] == sig[1]).mean() - both / (a.sum() + b.sum() - both)) < 0.04


def test_vectors(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(int(c * 100 + i), [float(x) for x in np.float32(center + 0.12 * rng.standard_normal(8))], c % 2) for c, center in enumerate(rng.standard_normal((6, 8))) for i in range(20)]
    rows += [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] * 8, 1), (903, [1.0] * 8, None), (904, [1.0, None], 0), (5, rows[5][1], rows[5][2])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "v"))
    got = near_vectors(spark.read.parquet(str(tmp_path / "v"))).collect()
    good = [r for r in rows if r[0] < 900]
    x = np.array([r[1] for r in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & (np.array([r[2] for r in good])[:, None] == np.array([r[2] for r in good])[None])
    np.fill_diagonal(near, False)
    want = sorted([(r[0], int(n)) for r, n in zip(good, near.sum(1))] + [(i, 0) for i in range(900, 905)])
    assert sorted((r.vec_id, r.n_links) for r in got) == want
    root = list(range(len(good)))
    for _ in good:
        root = [min(root[j] for j in np.flatnonzero(near[i] | (np.arange(len(good)) == i))) for i in range(len(good))]
    ids = [r[0] for r in good]
    least = {c: min(ids[i] for i in range(len(good)) if root[i] == c) for c in set(root)}
    named = collections.Counter((i, least[c]) for i, c in zip(ids, root))
    assert collections.Counter((r.vec_id, r.component_id) for r in got if r.vec_id < 900) == named
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_mix(docs):
    rows = mixture.mix_sources(plain(docs).withColumnRenamed("doc_id", "d").selectExpr("d AS doc_id", "text", "CASE WHEN d % 3 = 0 THEN NULL ELSE concat('s', d % 3) END AS source")).collect()
    again = mixture.mix_sources(plain(docs).withColumnRenamed("doc_id", "d").selectExpr("d AS doc_id", "text", "CASE WHEN d % 3 = 0 THEN NULL ELSE concat('s', d % 3) END AS source")).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    taken, size, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        taken[r.source] += r.size * r.copies
        size[r.source] += r.size
        target[r.source] = r.target
        assert 0 <= r.copies <= 3
    assert math.isclose(sum(target.values()), sum(size.values()))
    assert all(abs(taken[s] - target[s]) <= max(r.size for r in rows if r.source == s) for s in target)


def test_pivot_keeps_mass():
    rng = np.random.default_rng(0)
    size, part = rng.integers(1, 500, 300), rng.random(300)
    out = mixture.pivot_chain(size, part, rng.integers(0, 2**60, 300))
    assert math.isclose((size * out).sum(), (size * part).sum()) and ((out > 0) & (out < 1)).sum() <= 1


def test_substring(docs):
    out = substring_dedup.substring_dedup(docs.withColumnRenamed("_rid", "other"), min_words=3)
    assert out.count() == docs.count()
    seen = collections.Counter(" ".join(u.lower().split()) for r in out.collect() for u in (r.kept_text or "").split("\n") if len(u.split()) >= 3)
    assert max(seen.values()) == 1


def test_substring_query_judges_short_lines(spark):
    out, seen, want = {r.doc_id: r for r in QUERIES["op1_substring_dedup"](spark, SF).collect()}, set(), collections.Counter()
    short = 0
    for r in sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()):
        for line in (r.text or "").split("\n"):
            unit = " ".join(line.lower().split())
            want[r.doc_id] += bool(unit) and unit in seen
            short += bool(unit) and unit in seen and len(unit.split()) < 16
            seen.add(unit)
    assert short and {k: r.n_spans for k, r in out.items()} == dict(want)


def test_quality(spark):
    rows = [(" ".join(["good words and more of them"] * (k % 9 + 1)) if k % 4 else "JUNK!! " * (k % 7 + 3), int(k % 4 > 0)) for k in range(400)]
    d = spark.createDataFrame([*rows, (None, None), ("", None)], "text string, label int").withColumn("stats", quality.statistics(chat.F.col("text")))
    scored = d.select("label", quality.fit_rules(d).score(chat.F.col("stats")).alias("s")).collect()
    assert all((r.s >= 0.5) == bool(r.label) for r in scored if r.label is not None) and all(0 <= r.s <= 1 for r in scored)
    assert quality.fit_rules(d.where("label = 1")).rules == ()


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in QUERIES["op4_quality_classifier"](spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in rows) >= 0.95 * len(rows)


def test_chat_parts(spark):
    rows = [(1, 0, "user", [("text", "a <image> b\\", None, None), ("image", None, "u1", 19600.0), ("audio", None, "u2", 4.0), (None, "z", None, None)]), (1, 1, "assistant", [("text", "</s>[ROLE]", None, None)]), (1, 1, None, None)]
    out = chat.format_chat(spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts array<{chat.PART}>"))
    r = out.withColumn("turns", chat.read_turns(chat.F.col("formatted"))).withColumn("learned", chat.learned_text(chat.F.col("formatted"), chat.F.col("loss_spans"))).first()
    assert [(t.role, t.text) for t in r.turns] == [("user", "a <image> b\\<image><audio>z"), ("", ""), ("assistant", "</s>[ROLE]")]
    assert r.learned == "</s>[ROLE]" and [(a.ref, a.tokens) for a in r.attachments] == [("u1", 102), ("u2", 102)] and r.n_tokens_attached == 204


def test_urls(spark):
    urls = ["http://a.com/x", "https://www.EXAMPLE.com/en/1?q", "http://m.example.com/en/", "ftp://b.net/es/z", "http://b.net", None, "nothing", "http://acom/"]
    rules = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block")]
    mined = spark.createDataFrame([(["h:acom"], 0.9)], "rule array<string>, confidence double")
    got = {r.url: (r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame([(u,) for u in urls], "url string"), mined, rules).collect()}
    assert got == {urls[0]: ("com/", "allow"), urls[1]: ("www.example.com/en/", "allow"), urls[2]: ("example.com/en/", "block"), urls[3]: ("net/es/", "block"), urls[4]: (None, "allow"), None: (None, "allow"), "nothing": (None, "allow"), urls[7]: (None, "block")}


def test_mined_rules(spark):
    rows = [(f"http://{'bad' if k % 3 == 0 else 'ok'}.org/p{'' if k % 2 else '/q'}", k % 3 == 0) for k in range(90)]
    assert ["f:bad"] in [r.rule for r in url_filter.mine_rules(spark.createDataFrame(rows, "url string, block boolean")).collect()]


def test_rules_from_any_token(spark):
    told = ["http://a.b.c.d.e/x/y/win1000/%d", "http://a.bad.c.d.e/x/y/%d", "http://a.b/x/y/%d?k=1&l=2&m=3&n=4", "http://a.b/x/y/%d?k=evil"]
    for url, token in zip(told, ["p:win1000", "h:bad", "q:n", "v:k=evil"]):
        rows = [(url % k, True) for k in range(20)] + [(f"http://a.b.c.d.e/x/y/{k}?k=1&l=2&m=3", False) for k in range(40)]
        rules = url_filter.mine_rules(spark.createDataFrame(rows, "url string, block boolean"), min_support=0.1)
        pages = spark.createDataFrame([(url % 999,), ("http://a.b.c.d.e/x/y/999",)], "url string")
        assert [token] in [r.rule for r in rules.collect()]
        assert [r.verdict for r in url_filter.judge(pages, rules, []).collect()].count("block") == 1


def test_decontaminate_null_items(spark, docs):
    items = spark.createDataFrame([(None, "w1"), (7, None), (8, "")], "item_id long, text string")
    got = decontaminate.contamination(plain(docs), items).collect()
    assert len(got) == docs.count() and all(r.n_items == 0 for r in got) and any(r.n_hit for r in got)


def test_decontaminate_against_plain_windows(spark, docs):
    """Spans and items of all documents; items shorter than a window, repeated, sharing windows, and of words that no document has."""
    rng = random.Random(8)
    pattern = decontaminate.word_pattern()
    texts = [r.text for r in docs.select("text").collect() if r.text and len(r.text) > 400]
    asked = []
    for i in range(40):
        w = rng.choice(texts).split()
        a = rng.randrange(max(1, len(w) - 20))
        asked.append((i % 30, " ".join(w[a : a + rng.choice([1, 3, 9, 10, 14, 30])]).upper()))
    lowered = str.maketrans(decontaminate.UPPER, decontaminate.LOWER)
    asked += [(50, "abc " * 10), (51, "abc " * 12), (52, "never seen words"), (53, "..."), (54, None), (55, asked[0][1]), (None, asked[1][1])]
    for window in (10, 3):
        wins = collections.defaultdict(set)
        for item, text in asked:
            w = pattern.findall((text or "").translate(lowered))
            for s in range(max(1, len(w) - window + 1) if w else 0):
                wins[tuple(w[s : s + window])].add(item)
        want = collections.Counter()
        for text in (r.text for r in docs.select("text").collect()):
            w = pattern.findall((text or "").translate(lowered))
            hit, items = set(), set()
            for n in {len(x) for x in wins}:
                for s in range(len(w) - n + 1):
                    if tuple(w[s : s + n]) in wins:
                        hit |= set(range(s, s + n))
                        items |= wins[tuple(w[s : s + n])]
            want[len(w), len(hit), tuple(sorted(str(i) for i in items if i is not None))] += 1
        items = spark.createDataFrame(asked, "item_id long, text string").repartition(3)
        got = decontaminate.contamination(plain(docs), items, window).collect()
        assert collections.Counter((r.n_words, r.n_hit, tuple(r["items"])) for r in got) == want
        counted, spans = decontaminate.contaminated_spans(plain(docs), items, window)
        assert {r._rid for r in spans.collect()} == {r._rid for r in got if r.n_hit} and counted.count() == len(got)


CLASHES = ["row", "k", "n", "gone", "removed_lines", "removed", "n_removed", "kept_text", "size", "copies", "rank", "line", "component"]


@pytest.fixture
def clashing(spark, tmp_path):
    """Rows with columns of inner and output names, nulls, ties and repeated rows."""
    rows = [(i, t, "s", *[f"own{i}"] * len(CLASHES)) for i, t in enumerate(["one two three four five six\nx y", "x y\none two three four five six", None, "", "x y", "x y"])]
    spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES)).write.parquet(str(tmp_path / "c"))
    return spark.read.parquet(str(tmp_path / "c"))


def test_clashing_columns(spark, clashing, tmp_path, monkeypatch):
    import corpus_pipeline

    own = {i: f"own{i}" for i in range(6)}
    lines = line_dedup.line_dedup(clashing)
    assert len(set(lines.columns)) == len(lines.columns) == len(clashing.columns)
    assert all(r["size"] == own[r.doc_id] and r["row"] == own[r.doc_id] for r in lines.collect())
    assert {r.doc_id: r.text for r in lines.collect()} == {0: "one two three four five six\nx y", 1: "", 2: None, 3: "", 4: "", 5: ""}
    parts = substring_dedup.substring_dedup(clashing)
    assert len(set(parts.columns)) == len(parts.columns) and all(r["row"] == own[r.doc_id] for r in parts.collect())
    assert {r.doc_id: r.n_removed for r in parts.collect()} == {0: 0, 1: 2, 2: 0, 3: 0, 4: 1, 5: 1}
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, clashing, SF)
        assert len(set(out.columns)) == len(out.columns) >= len(clashing.columns), name
        assert all(r["row"] == own[r.doc_id] for r in out.collect()), name
    decontaminate.contamination(clashing, clashing.selectExpr("doc_id AS item_id", "text")).collect()


def test_rows_without_files_are_refused(spark):
    with pytest.raises(ValueError, match="write it"):
        line_dedup.line_dedup(spark.range(3).selectExpr("id AS doc_id", "'x' AS text"))


def test_part_borders_form_no_control_string(spark):
    rows = [(1, 0, "user", [("text", "<", None, None), ("text", "/s><s>[ROLE]x[/ROLE]", None, None)]), (1, 1, "user", [("text", "<ima", None, None), ("text", "ge>", None, None), ("text", "\\a", None, None)]), (1, 2, "assistant", [("text", "", None, None), ("text", "ok", None, None)])]
    out = chat.format_chat(spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts array<{chat.PART}>"))
    r = out.withColumn("turns", chat.read_turns(chat.F.col("formatted"))).withColumn("learned", chat.learned_text(chat.F.col("formatted"), chat.F.col("loss_spans"))).first()
    assert [t.text for t in r.turns] == ["</s><s>[ROLE]x[/ROLE]", "<image>\\a", "ok"] and r.learned == "ok" and r.attachments == []


def test_url_query_against_a_plain_model(spark):
    """Host, path, rule and mined rule of every page, the mined rules by a scan of all of them."""
    from taskloom.llm.queries import URL_RULES, op5_url_filter

    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    labels = collections.defaultdict(bool)
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        labels[r.doc_id] |= r.quality == 0 or r.toxic == 1
    rows = []
    for url in pages.values():
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        number = re.search(r"([0-9]{1,18})(?:/|\.html)?$", m[2]) if m else None
        if number and int(number[1]) in labels:
            rows.append((url, labels[int(number[1])]))
    mined = [(set(r.rule), r.rule, r.confidence) for r in url_filter.mine_rules(spark.createDataFrame(rows, "url string, block boolean")).collect()]
    tokens = {r.url: set(r.t) for r in spark.createDataFrame([(u,) for u in pages.values()], "url string").select("url", url_filter.tokens(chat.F.col("url")).alias("t")).collect()}
    for r in op5_url_filter(spark, SF).collect():
        url = pages[r.page_id]
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(len(t), t, v) for t, v in URL_RULES if (host == t.split("/", 1)[0] or host.endswith("." + t.split("/", 1)[0])) and path.startswith("/" + t.split("/", 1)[1])]
        best = max(fit) if fit else None
        sure = max(((c, rule) for have, rule, c in mined if have <= tokens[url]), default=None) if best is None and url else None
        assert (r.host, r.path, r.rule) == (host, path, best[1] if best else None)
        assert r.verdict == (best[2] if best else "block" if sure else "allow") and (r.mined or None) == (" ".join(sure[1]) if sure else None)


def test_score_is_what_the_rules_say(spark):
    rows = [([float(k % 7), float(k % 5), *[0.5] * 9], int(k % 7 > 3 and k % 5 < 3)) for k in range(300)]
    d = spark.createDataFrame(rows, "stats array<double>, label int")
    model = quality.fit_rules(d)
    assert model.rules
    for r in d.select("stats", model.score(chat.F.col("stats")).alias("s")).collect():
        z = model.intercept + sum(w for w, rule in model.rules if all((r.stats[k] > at) == above for k, above, at in rule))
        assert math.isclose(r.s, 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_targets_by_plain_filling(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    size = collections.Counter()
    for r in docs.collect():
        size[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight, open_, target, left = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}, set(names), {}, float(sum(size.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * size[s]}
        for s in full or open_:
            target[s] = 3.0 * size[s] if full else level * weight[s]
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    got = {r.source: (r.source_size, r.target) for r in mixture.mix_sources(docs).select("source", "source_size", "target").distinct().collect()}
    assert set(got) == set(target) and all(got[s][0] == size[s] and math.isclose(got[s][1], target[s], rel_tol=1e-9) for s in got)


def test_empty_tables(spark, none):
    e = plain(none)
    items = spark.createDataFrame([], "item_id long, text string")
    for df in (suffix_dedup.remove_repeats(e), near_dedup.near_groups(e), line_dedup.line_dedup(e), substring_dedup.substring_dedup(e), mixture.mix_sources(e.selectExpr("doc_id", "text", "'a' AS source")), decontaminate.contamination(e, items), chat.format_chat(spark.createDataFrame([], f"conv_id long, turn int, role string, parts array<{chat.PART}>"))):
        assert df.count() == 0
    assert url_filter.mine_rules(spark.createDataFrame([], "url string, block boolean")).count() == 0
    assert quality.fit_rules(spark.createDataFrame([], "stats array<double>, label int")).rules == ()
