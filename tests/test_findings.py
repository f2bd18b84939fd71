"""Names, installed artifacts, and the way from turns to findings."""

import datetime as dt
from math import log, sqrt

import pytest
from pyspark.sql import functions as F

from taskloom.operators import candidates, clusters, findings, naming
from taskloom.sources import inventory


def of(spark, f, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string").orderBy("i").select(f(F.col("s"))).collect()]


def test_steps_in_words(spark):
    actions = ["shell:npm run build", "mcp:slack:send-message", "mcp:linear", "tool:my-tool", "edit", "fly_home"]
    assert of(spark, naming.describe_step, *actions) == ["Run `npm run build`", "Call the slack integration (send message)", "Call the linear integration", "Use my tool", "Edit the affected files", "Perform fly home"]
    assert of(spark, naming.short_step, *actions) == ["npm run build", "slack", "linear", "my-tool", "edit", "fly_home"]


NAMED = "skill_ref string, verb string, phrases array<struct<phrase:string,score:double>>, keywords array<string>, tools array<string>, steps array<string>, commands array<string>, repos array<string>, said string"


@pytest.mark.parametrize(
    ("title", "row"),
    [
        ("eod", ("eod", "fix", [("a b", 2.0)], ["k"], [], [], [], [], "x")),
        ("Fix alert triage slack digest", (None, "fix", [("alert triage", 2.0), ("slack digest", 0.5)], ["k"], [], [], [], [], "x")),
        ("Reply to alert triage now", (None, "reply", [("alert triage now", 2.0), ("slack digest", 0.5)], ["k"], [], [], [], [], "x")),
        ("Slack channels", (None, None, [("weak one", 0.2)], ["k"], ["mcp:slack:search-channels"], ["mcp:slack:read-channel"], [], [], "x")),
        ("Set up git and Vercel deploy", (None, "set", [], ["git", "deploy"], ["shell"], ["shell:git push", "shell:vercel"], ["git push", "vercel"], [], "x")),
        ("Lint page style changes", (None, None, [], ["lint", "page", "style", "more"], ["edit"], [], [], [], "x")),
        ("Shop review", (None, None, [], [], ["read"], [], [], ["shop"], "x")),
        ("`make all`", (None, None, [], [], [], [], ["make all"], ["a", "b"], "x")),
        ("tidy the page", (None, None, [], [], [], [], [], [], "\n tidy  the page\nnow")),
        ("Recurring workflow", (None, None, [], [], [], [], [], [], None)),
    ],
)
def test_titles(spark, title, row):
    assert naming.title(spark.createDataFrame([row], NAMED)).first().title == title


def test_summaries(spark):
    schema = "runs int, sessions int, repos array<string>, agents array<string>, label string, steps array<string>"
    rows = [(6, 5, ["shop"], ["a"], "about daily", ["shell:git push", "mcp:slack:x", "edit", "read", "list"]), (2, 2, ["a", "b"], ["a", "b"], "once", []), (2, 2, [], [], None, [])]
    df = spark.createDataFrame(rows, schema)
    assert [r[0] for r in df.select(naming.summary_line(df)).collect()] == ["Ran 6 times across 5 sessions in shop, about daily. Usually: git push → slack → edit → read.", "Ran 2 times across 2 sessions in 2 repositories and 2 agents.", "Ran 2 times across 2 sessions."]


def test_installed_artifacts(spark, tmp_path):
    skills, commands, rules = (tmp_path / x for x in ("skills", "commands", "project"))
    (skills / "eod").mkdir(parents=True)
    (skills / "eod" / "SKILL.md").write_text("---\nname: \"EOD Report\"\ndescription: Summarize slack channels into a digest\n---\n# x\n")
    (skills / "bundle" / "skills" / "plain").mkdir(parents=True)
    (skills / "bundle" / "skills" / "plain" / "SKILL.md").write_text("no front matter")
    commands.mkdir()
    (commands / "ship.md").write_text("# Ship\n\n- list\nPush the release branch\n")
    rules.mkdir()
    (rules / "AGENTS.md").write_text("# Rules\nAlways lint the code\n")
    (rules / "notes.md").write_text("other")
    items = inventory.installed(spark, [(str(skills), "skill", "x", "user"), (str(commands), "command", "x", "user"), (str(rules), "rules", "x", "project")])
    got = {(r.kind, r.name): (r.description, r.path) for r in items.collect()}
    assert {k: v[0] for k, v in got.items()} == {("skill", "EOD Report"): "Summarize slack channels into a digest", ("skill", "plain"): "", ("command", "ship"): "Push the release branch", ("rules", "AGENTS.md"): "Always lint the code"}
    wanted = spark.createDataFrame([(1, ["slack", "digest", "channels", "weekly"]), (2, ["release", "lint", "x", "y"]), (3, []), (4, ["push", "ship"])], "id long, tokens array<string>")
    assert {r.id: (r.match, r.path.rpartition("/")[2]) for r in inventory.best_match(wanted, items).collect()} == {1: (0.75, "SKILL.md"), 4: (1.0, "ship.md")}
    names = spark.createDataFrame([(1, "eod report"), (2, "none")], "id long, name string")
    assert [(r.id, r.path) for r in inventory.named_alike(names, items).collect()] == [(1, got[("skill", "EOD Report")][1])]
    assert inventory.installed(spark, []).count() == 0


TURNS = "agent string, repo string, session string, idx int, actor string, kind string, at timestamp, text string, tool string, command string, is_error boolean, skills array<string>, paths array<string>"


def turns_of_days(days=6):
    rows = []
    for d in range(days):
        at, s = dt.datetime(2024, 3, 1 + d, 9), f"s{d}"
        said = [("user", "message", "review the slack alerts channel and write the digest page", None, None), ("assistant", "tool_call", None, "mcp:slack:read-channel", None), ("assistant", "tool_call", None, "edit", None), ("assistant", "tool_call", None, "shell", "npm run lint"), ("assistant", "tool_call", None, "shell", "git push")]
        if d in (1, 4):
            said.insert(3, ("user", "message", "always run the linter before you push" if d == 1 else "never push before the linter has run", None, None))
        if d == 2:
            said.insert(3, ("user", "message", "no, use the other page", None, None))
        for i, (actor, kind, text, tool, command) in enumerate(said):
            rows.append(("claude", "shop", s, i, actor, kind, at + dt.timedelta(minutes=2 * i), text, tool, command, False, None, ["ui/page/*.tsx"] if tool == "edit" else None))
    at = dt.datetime(2024, 3, 20)
    rows += [("codex", "api", "other", 0, "user", "message", at, "what does this regular expression match", None, None, False, None, None), ("codex", "api", "other", 1, "assistant", "tool_call", at, None, "read", None, False, None, None)]
    return rows


def test_findings_and_rules(spark):
    turns = spark.createDataFrame(turns_of_days(), TURNS)
    items = spark.createDataFrame([("skill", "digest", "", "/s/digest", "x", "user", ["review", "slack", "alerts", "channel", "write", "digest", "page", "npm", "run", "lint", "git", "push"])], "kind string, name string, description string, path string, harness string, scope string, tokens array<string>")
    every = findings.findings(turns)
    found = every.collect()
    assert len(found) == findings.actionable(every).count() == 1 and findings.actionable(every.withColumn("kind", F.lit("ignore"))).count() == 0
    f = found[0]
    assert (f.rank, f.runs, f.sessions, f.days, f.label, f.agents, f.repos) == (1, 6, 6, 6, "about daily", ["claude"], ["shop"])
    assert f.steps == ["mcp:slack:read-channel", "edit", "shell:npm run lint", "shell:git push"] and f.commands == ["git push", "npm run lint"] and f.paths == ["ui/page/*.tsx"]
    assert f.title.startswith("Review ") and f.kind != "ignore" and f.cohesion > 0.6 and f.summary.startswith("Ran 6 times across 6 sessions in shop, about daily. Usually: slack → edit")
    matched = findings.findings(turns, items).first()
    assert (matched.kind, matched.existing) == ("update", "/s/digest")
    rule = findings.rules(turns).collect()
    assert len(rule) == 1 and (rule[0].occurrences, rule[0].sessions, rule[0].agents, rule[0].repos) == (2, 2, ["claude"], ["shop"]) and "linter" in rule[0].keywords
    assert tuple(findings.window(turns).first()) == (dt.datetime(2024, 3, 1, 9), dt.datetime(2024, 3, 20))


def test_cohesion_within_groups(spark):
    words = {0: {"a": 2, "b": 1}, 1: {"a": 1}, 2: {"c": 3, "a": 1}, 3: {}}
    items, leader = {0: {"x"}, 1: {"x", "y"}, 2: set(), 3: set()}, {0: 0, 1: 0, 2: 0, 3: 3}
    centres = {(0, "a"): 1.5, (0, "c"): 0.5}
    got = clusters.cohesion(
        spark.createDataFrame(list(leader.items()), "n long, leader long"), spark.createDataFrame([(n, t, c) for n, w in words.items() for t, c in w.items()], "n long, token string, tf long"),
        spark.createDataFrame([(n, i) for n, s in items.items() for i in s], "n long, item string"), spark.createDataFrame([(0, "x"), (0, "y")], "leader long, item string"), spark.createDataFrame([(*k, v) for k, v in centres.items()], "leader long, token string, weight double"),
    )
    fits = []
    for n in (0, 1, 2):
        df = {t: sum(t in words[m] for m in (0, 1, 2)) for t in words[n]}
        own = {t: (1 + log(c)) * (log(4 / (df[t] + 1)) + 1) for t, c in words[n].items()}
        fits.append(0.55 * sum(x * centres.get((0, t), 0.0) for t, x in own.items()) / (sqrt(sum(x * x for x in own.values())) * sqrt(2.5)) + 0.45 * len(items[n]) / 2)
    assert {r.leader: r.cohesion for r in got.collect()} == pytest.approx({0: sum(fits) / 3, 3: 0.45})


def test_wishes_join_growing_groups(spark):
    said = ["lint code tests", "lint code", "code tests docs extra", "docs extra more words", "metric units", "x", "units metric please"]
    rows = spark.createDataFrame([(i, f"s{i}", t) for i, t in enumerate(said)], "at int, session string, text string")
    got = {r.at: r.group for r in candidates.group_wishes(rows, ["at"]).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0 if 2 / 7 >= 0.34 else 3, 4: 4, 6: 4}
