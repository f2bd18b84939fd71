"""Arcs against a turn-by-turn model, over random streams."""

import datetime as dt
import random

from taskloom.operators.segment import arcs

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "session long, idx int, actor string, kind string, at timestamp, text string, tool string, command string, is_error boolean"


def model(turns):
    out, arc, prev = [], None, None

    def close():
        nonlocal arc
        if arc and (len(arc["steps"]) >= 2 or arc["corrections"]):
            out.append((arc["turns"], tuple(arc["steps"]), arc["errors"], arc["retries"], arc["corrections"]))
        arc = None

    def fresh(turns):
        return {"turns": turns, "steps": [], "errors": 0, "retries": 0, "corrections": 0, "last": None, "failed": False}

    for t in turns:
        at, kind, text = t[4], t[3], t[5]
        if at and prev and at - prev > dt.timedelta(minutes=90):
            close()
        prev = at or prev
        if kind == "message" and t[2] == "user":
            if not text.strip():
                continue
            if arc is None:
                arc = fresh(1)
            elif text == "ok":
                arc["turns"] += 1
            elif text == "never do that":
                arc["turns"] += 1
                arc["corrections"] += 1
            else:
                close()
                arc = fresh(1)
        elif kind == "tool_call":
            arc = arc or fresh(0)
            arc["turns"] += 1
            arc["retries"] += t[6] == arc["last"] and arc["failed"]
            if t[6] != arc["last"]:
                arc["steps"].append(t[6])
            arc["last"] = t[6]
        elif kind == "tool_result" and arc:
            arc["errors"] += t[8]
            arc["failed"] = t[8]
        elif kind == "message" and arc:
            arc["turns"] += 1
    close()
    return out


def test_arcs_match_the_model(spark):
    rng, rows, want = random.Random(5), [], {}
    for session in range(150):
        at, turns = T0, []
        for idx in range(rng.randint(1, 25)):
            at += dt.timedelta(minutes=rng.choice([1, 5, 89, 90, 91, 300, -2]))
            kind = rng.choice(["prompt", "call", "call", "result", "say"])
            when = None if rng.random() < 0.15 else at
            if kind == "prompt":
                row = ("user", "message", when, rng.choice(["ok", "never do that", "build the report", "  "]), None, None, False)
            elif kind == "call":
                row = ("assistant", "tool_call", when, None, rng.choice("ab"), None, False)
            elif kind == "result":
                row = ("tool", "tool_result", when, "", None, None, rng.random() < 0.5)
            else:
                row = ("assistant", "message", when, "done", None, None, False)
            turns.append((session, idx, *row))
        rows += turns
        want[session] = model(turns)
    got = {s: [] for s in want}
    for r in arcs(spark.createDataFrame(rows, SCHEMA)).orderBy("session", "arc").collect():
        got[r.session].append((r.turns, tuple(r.steps), r.errors, r.retries, r.corrections))
    assert got == want
