"""Grouping in order, held to a plain sequential pass with growing groups."""

import random
from math import sqrt
from pathlib import Path

import pytest

from taskloom.operators import leaders


def plain_pass(rows, threshold, weight, first=False):
    """rows: [(items, vector)] in order; returns the leader of each and the states."""
    groups, out = [], []
    for n, (items, vector) in enumerate(rows):
        found = []
        for g in groups:
            dot = sum(x * g["sum"].get(t, 0.0) for t, x in vector.items())
            size = sqrt(sum(x * x for x in vector.values())) * sqrt(sum(x * x for x in g["sum"].values()))
            union = items | g["items"]
            fit = round(weight * (dot / size if size else 0.0) + (1 - weight) * (len(items & g["items"]) / len(union) if union else 1.0), 12)
            if fit >= threshold:
                found.append((0 if first else -fit, g["n"], g))
        if found:
            g = min(found, key=lambda f: f[:2])[2]
            g["size"] += 1
            if first:
                g["sum"] = {t: (g["sum"].get(t, 0.0) + vector.get(t, 0.0)) / 2 for t in {*g["sum"], *vector}}
            else:
                g["sum"] = {t: g["sum"].get(t, 0.0) + vector.get(t, 0.0) for t in {*g["sum"], *vector}}
            g["items"] = g["items"] | items
        else:
            g = {"n": n, "sum": dict(vector), "items": set(items), "size": 1}
            groups.append(g)
        out.append(g["n"])
    return out, groups


def plain_leaders(rows, merges=4):
    of, groups = plain_pass(rows, 0.42, 0.55)
    for g in groups:
        g["sum"] = {t: x / g["size"] for t, x in g["sum"].items()}
    for _ in range(merges):
        into, after = plain_pass([(g["items"], g["sum"]) for g in groups], 0.55, 0.55, first=True)
        name = {g["n"]: groups[k]["n"] for g, k in zip(groups, into)}
        if len(after) == len(groups):
            break
        of = [name[x] for x in of]
        for g in after:
            g["n"] = groups[g["n"]]["n"]
        groups = after
    return of, groups


def random_rows(seed, n=70):
    rng = random.Random(seed)
    kinds = [([f"s{rng.randint(0, 9)}" for _ in range(rng.randint(2, 5))], [f"w{rng.randint(0, 30)}" for _ in range(6)]) for _ in range(7)]
    rows = []
    for _ in range(n):
        steps, words = rng.choice(kinds)
        items = {s if rng.random() < 0.85 else f"s{rng.randint(0, 9)}" for s in steps} if rng.random() < 0.85 else set()
        vector = {w if rng.random() < 0.8 else f"w{rng.randint(0, 30)}": rng.choice([1.0, 1.5, 2.0]) for w in words} if rng.random() < 0.92 else {}
        rows.append((items, vector))
    return rows + rows[:5]


def frames(spark, rows):
    ns = spark.createDataFrame([(n,) for n in range(len(rows))], "n long")
    items = spark.createDataFrame([(n, i) for n, (s, _) in enumerate(rows) for i in s], "n long, item string")
    tokens = spark.createDataFrame([(n, t, x) for n, (_, v) in enumerate(rows) for t, x in v.items()], "n long, token string, weight double")
    return ns, items, tokens


@pytest.mark.parametrize(("seed", "in_turn", "n"), [(1, 2000, 300), (2, 9, 26)])
def test_leader_pass_and_merges(spark, monkeypatch, seed, in_turn, n):
    """In one block, and by passes over all rows with small blocks where they don't settle."""
    monkeypatch.setattr(leaders, "IN_TURN", in_turn)
    monkeypatch.setattr(leaders, "BLOCK_BITS", 2)
    rows = random_rows(seed, n)
    groups, sets, centres = leaders.leader_pass(*frames(spark, rows))
    want, states = plain_leaders(rows)
    assert [r.leader for r in groups.orderBy("n").collect()] == want
    assert {(r.leader, r.item) for r in sets.collect()} == {(g["n"], i) for g in states for i in g["items"]}
    got = {(r.leader, r.token): r.weight for r in centres.collect()}
    assert got == pytest.approx({(g["n"], t): x for g in states for t, x in g["sum"].items()})


def test_jaccard_alone_by_passes(spark, monkeypatch):
    monkeypatch.setattr(leaders, "IN_TURN", 1)
    rows = [(items, {}) for items, _ in random_rows(3, 24) if items]
    got = leaders.greedy_groups(*frames(spark, rows), 0.34, 0.0)
    assert [r.leader for r in got.orderBy("n").collect()] == plain_pass(rows, 0.34, 0.0)[0]


def test_numbers_follow_the_order(spark):
    rows = spark.createDataFrame([(i * 7 % 50, None if i % 9 == 0 else i % 4) for i in range(50)], "k long, t long")
    got = leaders.numbered(rows, "t", "k").orderBy("n").collect()
    assert [r.n for r in got] == list(range(50)) and [(r.t is not None, r.t or 0, r.k) for r in got] == sorted((r.t is not None, r.t or 0, r.k) for r in got)


@pytest.mark.parametrize("seed", [4, 5])
def test_sets_alone_in_several_blocks(spark, monkeypatch, seed):
    """Rows that only a grown group is like, copies, and rows without items; compared by sixteen, settled by twenty."""
    monkeypatch.setattr(leaders, "COMPARED", 16)
    monkeypatch.setattr(leaders, "IN_TURN", 20)
    rng = random.Random(seed)
    rows = [({f"i{min(k + rng.randint(0, 4), 59)}" for _ in range(rng.randint(3, 6))}, {}) for k in (rng.randint(0, 59) for _ in range(110))]
    rows += [({f"{n}x", f"{n}y", f"{n}z"}, {}) for n in range(30)]
    rng.shuffle(rows)
    rows += [(set(), {}), ({"i1"}, {}), (set(), {})]
    got = leaders.greedy_groups(*frames(spark, rows), 0.34, 0.0)
    assert [r.leader for r in got.orderBy("n").collect()] == plain_pass(rows, 0.34, 0.0)[0]


def test_grouping_keeps_no_table_but_its_result(spark):
    """Each pass left its pairs, sums and choices behind, which grow with the square of the rows that share words."""
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    rows = [({f"a{n}", f"a{n + 1}", "b", "c"}, {}) for n in range(40)]
    ns, items, tokens = frames(spark, rows)
    before = {*folder.glob("taskloom-*")}
    got = leaders.greedy_groups(ns, items, tokens, 0.34, 0.0)
    assert len({*folder.glob("taskloom-*")} - before) == 1
    assert [r.leader for r in got.orderBy("n").collect()] == plain_pass(rows, 0.34, 0.0)[0]


@pytest.mark.parametrize("first", [False, True])
def test_rows_of_few_kinds(spark, monkeypatch, first):
    """Kept in a table, over three blocks; each block is two tables written at most, where a pass over all rows wrote eight and settled few."""
    monkeypatch.setattr(leaders, "IN_TURN", 50)
    kinds, rng, calls = random_rows(6, 16), random.Random(7), []
    rows = [rng.choice(kinds) for _ in range(140)]
    monkeypatch.setattr(leaders, "written", lambda df, f=leaders.written: calls.append(1) or f(df))
    got = leaders.greedy_groups(*frames(spark, rows), 0.42, 0.55, first)
    assert [r.leader for r in got.orderBy("n").collect()] == plain_pass(rows, 0.42, 0.55, first)[0]
    assert len(calls) <= 8
