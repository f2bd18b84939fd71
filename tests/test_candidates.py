"""Functions and operators of mining against values worked out by hand and plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from taskloom.functions import commands, prompts
from taskloom.functions import text as T
from taskloom.functions.redact import redact
from taskloom.operators import candidates, classify, scoring, similar


def of(spark, f, *values, schema="s string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}").orderBy("i").select(f(F.col(schema.split()[0]))).collect()]


def test_prompts(spark):
    assert of(spark, prompts.skill_refs, "see ~/.x/skills/eod-report/SKILL.md and Using the team:triage skill, skills/eod-report", "none") == [["eod-report", "triage"], []]
    assert of(spark, prompts.without_skill_refs, "Using the triage skill\nBase directory for this skill: /x\nsort mail") == ["sort mail"]
    assert of(spark, prompts.repair_punctuation, "itâ€™s â€” fine", "naïve ok", "Â·") == ["it’s — fine", "naïve ok", "·"]
    assert of(spark, lambda c: prompts.gist(c, 9), "# title\n- item\n```\ncode\n```\nadd   the page now", "") == ["add the p…", ""]
    assert of(spark, prompts.slash_command, "<command-name>/eod</command-name>", "<command-name>clear</command-name>", "x") == ["/eod", None, None]


def test_commands(spark):
    raw = '{"file_path": "/a/b/c/d.PY", "files": ["x/y.ts", "z"], "n": 3, "deep": {"k": 1}, "cmd": " ls "}'
    args = spark.createDataFrame([(raw,), ("plain words",), ("{broken",), (None,)], "s string").select(commands.flatten_args(F.col("s")).alias("a"))
    got = args.select("a", commands.path_shapes(F.col("a")).alias("p"), commands.extract_command(F.col("a")).alias("c")).collect()
    assert got[0].a == {"file_path": "/a/b/c/d.PY", "files": "x/y.ts, z", "n": "3", "cmd": " ls "} and got[0].p == ["b/c/*.py", "x/*.ts"] and got[0].c == " ls "
    assert got[1].a == {"input": "plain words"} and got[2].a in ({"input": "{broken"}, None) and got[3].a is None
    assert of(spark, commands.repo_name, "/w/shop/", "C:\\w\\api", "") == ["shop", "api", ""]
    assert of(spark, lambda c: commands.failed(c, status=F.lit("ok")), "12 passed, 0 failed, no errors", "Error: x", "exit code 1") == [False, True, True]


def test_text(spark):
    assert of(spark, T.meaningful, "deadbeef", "abcdeffa", "facade", "aaaab", "go", "word") == [False, False, True, False, False, True]
    assert of(spark, lambda c: T.top_counted(c, 2), ["b", "a", "b", "c", "a"], schema="s array<string>") == [["a", "b"]]
    secret = 'Bearer abcdefghijkl12 and API_KEY="abcdefgh99" me@x.org https://u:p@h/'
    assert of(spark, redact, secret) == ["Bearer [redacted] and API_KEY=[redacted] [redacted:email] https://[redacted:credentials]@h/"]


def test_pairs_and_groups(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    sets = [(i, rng.sample(words[: 8 + i % 20], rng.randint(0, 6))) for i in range(60)]
    vectors = [(i, w, 1.0 + rng.random()) for i, s in sets for w in s]
    s, v = spark.createDataFrame(sets, "id long, items array<string>"), spark.createDataFrame(vectors, "id long, token string, weight double")
    weight = {i: {w: x for j, w, x in vectors if j == i} for i, _ in sets}

    def jac(a, b):
        return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0

    def cos(a, b):
        norm = sum(x * x for x in weight[a].values()) * sum(x * x for x in weight[b].values())
        return sum(x * weight[b].get(w, 0) for w, x in weight[a].items()) / norm**0.5 if norm else 0.0

    pairs = [(a, b) for a, _ in sets for b, _ in sets if a < b]
    items = dict(sets)
    assert {(r.a, r.b) for r in similar.jaccard_pairs(s, 0.4).collect()} == {(a, b) for a, b in pairs if items[a] and items[b] and jac(items[a], items[b]) >= 0.4}
    assert {(r.a, r.b) for r in similar.cosine_pairs(v, 0.5).collect()} == {(a, b) for a, b in pairs if cos(a, b) >= 0.5}
    near = {(a, b) for a, b in pairs if 0.55 * cos(a, b) + 0.45 * jac(items[a], items[b]) >= 0.42}
    full = {(a, b) for a, b in near if items[a] or items[b]}
    assert {(r.a, r.b) for r in similar.blended_pairs(v, s).collect() if items[r.a] or items[r.b]} == full
    root = {i: i for i, _ in sets}
    for _ in sets:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.id: r.group for r in similar.groups(s.select("id"), similar.blended_pairs(v, s)).collect()}
    assert got == root
    members = spark.createDataFrame([(i, root[i]) for i in root], "id long, `group` long")
    cohesion = {r.group: r.cohesion for r in similar.cohesion(members, v, s).collect()}
    alone = next(i for i in root if list(root.values()).count(root[i]) == 1 and items[i])
    assert cohesion[alone] == pytest.approx(1.0) and all(0 <= c <= 1 + 1e-9 for c in cohesion.values())
    assert {r.id for r in similar.alike_groups(v, s).collect()} == {i for i in root if list(root.values()).count(root[i]) >= 3}


def test_phrases_verbs_and_rules(spark):
    scored = spark.createDataFrame([("g", "alert triage", 2.0, 3), ("g", "triage alerts now", 1.5, 3), ("g", "slack digest", 1.0, 2)], "g string, phrase string, score double, df long")
    assert [(p.phrase, p.score) for p in candidates.top_phrases(scored, "g").first().phrases] == [("alert triage", 2.0), ("slack digest", 1.0)]
    said = [("a", "Please review the diff"), ("a", "review, then merge"), ("a", "what is this"), ("b", "deploy it"), ("b", "fix it"), ("b", "why"), ("c", "  ")]
    assert {r.g: r.verb for r in candidates.dominant_verb(spark.createDataFrame(said, "g string, text string"), "g").collect()} == {"a": "review", "b": None}
    wishes = [(1, "s1", "always run linter first"), (2, "s2", "never skip the linter run"), (3, "s3", "remember metric units")]
    grouped = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "id long, `group` long")
    rules = candidates.rule_groups(spark.createDataFrame(wishes, "id long, session string, text string"), grouped).collect()
    assert len(rules) == 1 and rules[0].occurrences == 2 and rules[0].sessions == 2 and rules[0].text == "always run linter first" and rules[0].keywords[:2] == ["linter", "run"]
    arcs = spark.createDataFrame([("g", ["eod"]), ("g", ["eod", "x"]), ("g", [])], "g string, skills array<string>")
    assert [tuple(r) for r in candidates.skill_share(arcs, "g").collect()] == [("g", "eod", 0.667)]


BASE = {"days": 6, "label": "about daily", "regularity": 0.9, "steps": ["edit", "write", "shell:make", "browser"], "turns": 5.0, "phrase": 4.0, "error_rate": 0.5, "n_corrections": 2, "n_standing": 1, "n_repos": 4, "n_agents": 1, "minutes": 10.0, "runs": 6, "sessions": 6, "cohesion": 0.8}
SCHEMA = "days long, label string, regularity double, steps array<string>, turns double, phrase double, error_rate double, n_corrections int, n_standing int, n_repos int, n_agents int, minutes double, runs long, sessions long, cohesion double"


def scored(spark, **changes):
    return scoring.score(spark.createDataFrame([tuple({**BASE, **changes}.values())], SCHEMA))


def test_scores(spark):
    r = scored(spark).first()
    assert r.total == r.raw and r.penalties == [] and r.breadth == pytest.approx(0.6) and r.reasons[0] == "the prompts repeat the same context each time" and len(r.reasons) == 4
    r = scored(spark, steps=["read"], days=1, sessions=1, cohesion=0.2).first()
    assert r.penalties == ["generic", "single-step", "loose-cluster", "single-day", "in-session-loop"] and r.penalty == pytest.approx(0.5 * 0.65 * 0.7 * 0.55 * 0.75) and r.total < r.raw


@pytest.mark.parametrize(
    ("kind", "changes", "more"),
    [
        ("update", {}, {"skill_ref": "eod", "skill_share": 0.7}), ("update", {}, {"match": 0.6}), ("ignore", {"days": 1}, {"min_score": 35.0}), ("hook", {"steps": ["shell:git push", "read", "edit"]}, {}),
        ("reference", {"steps": ["read", "search"]}, {"min_score": 5.0}), ("command", {"steps": ["edit", "write"]}, {}), ("skill", {}, {}),
    ],
)
def test_kinds(spark, kind, changes, more):
    c = scored(spark, **changes).withColumns({"first_support": F.lit(0.9), "skill_ref": F.lit(more.get("skill_ref")).cast("string"), "skill_share": F.lit(more.get("skill_share")).cast("double"), "match": F.lit(more.get("match")).cast("double")})
    assert classify.classify(c, more.get("min_score", 28.0)).first().kind == kind


def test_finding_and_ranks(spark):
    found = spark.createDataFrame([(1, "abc1", "alpha"), (2, "abd2", "abc")], "rank int, id string, slug string")
    assert [candidates.find(found, n).first() and candidates.find(found, n).first().rank for n in ("abc", "abd", "al", "abc1")] == [2, 2, None, 1]
    truths = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, [])], "truth_id long, tokens array<string>")
    ranked = candidates.ranks(truths, spark.createDataFrame([(1, ["x", "a"]), (2, ["c", "d", "a"]), (3, ["c"])], "rank int, tokens array<string>"))
    assert {r.truth_id: r["rank"] for r in ranked.collect()} == {1: 1, 2: 3, 3: None}
    assert tuple(candidates.recall(ranked).first()) == (3, pytest.approx(1 / 3), pytest.approx(2 / 3), pytest.approx(2 / 3), pytest.approx(2 / 3), pytest.approx((1 + 1 / 3) / 3))


def test_evidence_is_spread(spark):
    arcs = spark.createDataFrame([("g", f"a{i:02}", dt.datetime(2024, 1, 1 + i)) for i in range(20)] + [("h", "b", None)], "g string, arc_id string, start timestamp")
    got = sorted((r.g, r.pick, r.arc_id) for r in candidates.evidence(arcs, "g").collect())
    assert got == [("g", i, f"a{int(i * 19 / 7 + 0.5):02}") for i in range(8)] + [("h", 0, "b")]


def test_many_equal_rows_are_one_class(spark):
    n = 100_000
    sets = spark.range(n + 2).select("id", F.when(F.col("id") < n, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("z"))).alias("items"))
    vectors = spark.range(n).select("id", F.lit("t").alias("token"), F.lit(1.5).alias("weight"))
    assert [tuple(r) for r in similar.alike_groups(vectors, sets).groupBy("group").count().collect()] == [(0, n)]
