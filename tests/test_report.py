"""Windows, labels, standing wishes that are covered or not, and the report as a whole."""

import datetime as dt

from pyspark.sql import functions as F
from test_findings import TURNS, turns_of_days

from taskloom.operators import report

ITEM = "kind string, name string, description string, path string, harness string, scope string, tokens array<string>"


def test_labels(spark):
    now = dt.datetime(2024, 3, 9, 12)
    ages = {0: "just now", 59: "just now", 60: "1 minutes ago", 3599: "59 minutes ago", 3600: "1 hours ago", 86399: "23 hours ago", 86400: "1 days ago", 200_000: "2 days ago", -30: "just now"}
    rows = spark.createDataFrame([(k, now - dt.timedelta(seconds=k)) for k in ages] + [(None, None)], "k int, at timestamp")
    got = {r.k: (r.age, r.range) for r in rows.select("k", report.age_label(F.col("at"), F.lit(now)).alias("age"), report.range_label(F.col("at"), F.lit(now)).alias("range")).collect()}
    assert {k: v[0] for k, v in got.items()} == {**ages, None: "unknown"}
    assert got[0][1] == "2024-03-09 → 2024-03-09" and got[200_000][1] == "2024-03-07 → 2024-03-09" and got[None][1] == "undated"
    assert report.cutoff(0, now) is None and report.cutoff(-1, now) is None and report.cutoff(2, now) == dt.datetime(2024, 3, 7, 12)


def test_window_without_dates_or_rows(spark):
    stats = spark.createDataFrame([("a", 2, None, None), ("b", 3, dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 5))], "agent string, sessions long, earliest timestamp, latest timestamp")
    assert tuple(report.window(stats).first()) == (dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 5), 5, 2, "2024-01-02 → 2024-01-05")
    assert tuple(report.window(stats.where("false")).first()) == (None, None, 0, 0, "undated")


def test_rules_that_a_file_covers_are_ignored(spark):
    rules = spark.createDataFrame([("r1", 2, ["lint", "push"]), ("r2", 7, ["metric", "units"]), ("r3", 3, []), ("r4", 3, ["tabs", "spaces", "x"])], "rule_id string, occurrences long, keywords array<string>")
    items = spark.createDataFrame([("rules", "AGENTS.md", "", "/a", "x", "user", ["lint", "push", "tabs"]), ("skill", "units", "", "/b", "x", "user", ["metric", "units"])], ITEM)
    told = report.decided(rules, items)
    assert {r.rule_id: (r.kind, r.existing, r.confidence) for r in told.collect()} == {"r1": ("ignore", "/a", 1.0), "r2": ("rule", None, 1.0), "r3": ("rule", None, 0.6), "r4": ("rule", None, 0.6)}
    assert [(r.rule_id, r["rank"]) for r in report.actionable_rules(told).orderBy("rank").collect()] == [("r2", 1), ("r3", 2), ("r4", 3)]
    assert report.decided(rules, None).where("kind = 'rule'").count() == 4 and report.decided(rules.where("false"), items).count() == 0


def test_report(spark):
    turns = spark.createDataFrame(turns_of_days(), TURNS)
    items = spark.createDataFrame([("rules", "AGENTS.md", "", "/a", "x", "user", ["run", "the", "linter", "before", "push"])], ITEM)
    out = report.report(turns, items, days=30, now=dt.datetime(2024, 3, 21))
    assert tuple(out["window"].first())[2:4] == (7, 2) and {r.agent: r.sessions for r in out["stats"].collect()} == {"claude": 6, "codex": 1}
    assert [r["rank"] for r in out["findings"].collect()] == [1]
    assert [(r.kind, r.existing) for r in out["rules"].collect()] == [("ignore", "/a")] and report.actionable_rules(out["rules"]).count() == 0
    late = report.report(turns, days=2, now=dt.datetime(2024, 3, 21))
    assert tuple(late["window"].first())[2:4] == (1, 1) and late["findings"].count() == 0 and late["rules"].count() == 0
