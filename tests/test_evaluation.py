"""Ranks as of a date, equal to grouping anew for every truth."""

import datetime as dt
import random

from taskloom.operators import evaluation, leaders
from test_leaders import frames, plain_pass, random_rows


def test_ranks_as_of_a_date(spark):
    rng = random.Random(6)
    rows = random_rows(5, 120)
    start = [None if n < 4 else dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * (n // 2)) for n in range(len(rows))]
    words = [sorted(v) for _, v in rows]
    truths = [(k, rng.choice([None, *start[4:], dt.datetime(2024, 1, 9, 3), dt.datetime(2023, 1, 1)]), rng.sample(sorted({w for x in words for w in x}), 9)) for k in range(25)] + [(99, None, [])]
    ns, items, tokens = frames(spark, rows)
    groups = leaders.greedy_groups(ns, items, tokens, 0.42, 0.55)
    got = evaluation.ranks_as_of(
        spark.createDataFrame(truths, "truth_id long, cutoff timestamp, tokens array<string>"), spark.createDataFrame(list(enumerate(start)), "n long, start timestamp"), groups,
        spark.createDataFrame([(n, w) for n, x in enumerate(words) for w in x], "n long, token string"), 0.4,
    )
    want = {}
    for key, cutoff, wanted in truths:
        known = [n for n in range(len(rows)) if cutoff is None or start[n] is None or start[n] < cutoff]
        of, _ = plain_pass([rows[n] for n in known], 0.42, 0.55)
        members = {g: [known[k] for k, x in enumerate(of) if x == g] for g in set(of)}
        want[key] = None
        for mine in members.values():
            held = {w for n in mine for w in words[n] if sum(w in words[m] for m in mine) / len(mine) >= 0.34}
            if len(mine) >= 3 and held and len(held & set(wanted)) / len(held) >= 0.4:
                rank = 1 + sum(len(m) > len(mine) for m in members.values())
                want[key] = min(want[key] or rank, rank)
    assert {r.truth_id: r["rank"] for r in got.collect()} == want and any(want.values())
