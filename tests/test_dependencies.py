"""States of changes along chains and around circles against a plain walk."""

import random

import pytest

from memgrid.operators import dependencies, skew

KIND = "event_id long, depends_on array<long>, retry_count int, max_retries int, failed boolean"


def plain(rows):
    own = {e: "done" if not f else "retry" if r < m else "dead" for e, _, r, m, f in rows}
    needs = {e: set(d or []) if own[e] == "done" else set() for e, d, *_ in rows}

    def reach(e):
        seen, todo = set(), list(needs[e])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += needs.get(x, ())
        return seen

    far = {e: reach(e) for e in own}
    circle = {e for e in own if e in far[e]}
    out = {}
    for e in own:
        if own[e] != "done":
            out[e] = own[e]
        elif any(own.get(x) == "dead" for x in far[e]):
            out[e] = "blocked"
        elif e in circle:
            out[e] = "circle"
        else:
            out[e] = "waiting" if any(own.get(x) in (None, "retry") or x in circle for x in far[e]) else "done"
    return out


def states(spark, rows):
    return {r["event_id"]: r["state"] for r in dependencies.settled(spark.createDataFrame(rows, KIND)).collect()}


def done(e, *needs):
    return (e, list(needs), 0, 6, False)


def test_four_in_a_chain(spark):
    rows = [(1, [], 6, 6, True), done(2, 1), done(3, 2), done(4, 3)]
    assert states(spark, rows) == {1: "dead", 2: "blocked", 3: "blocked", 4: "blocked"}


@pytest.mark.parametrize("few", [skew.FEW, 0])
def test_chain_of_a_thousand_and_circles(spark, monkeypatch, few):
    monkeypatch.setattr(skew, "FEW", few)
    rows = [(0, None, 6, 6, True), *(done(e, e - 1) for e in range(1, 1001))]  # blocked to the end
    rows += [done(2000), *(done(e, e - 1, e - 1) for e in range(2001, 2100))]  # done to the end
    rows += [done(3000 + e, 3000 + (e + 1) % 50) for e in range(50)] + [done(3100, 3007), done(3101, 3100, 3100)]  # a circle of single needs, and what waits for it
    rows += [done(4000, 4001, 4002), done(4001, 4003), done(4002, 4004), done(4003, 4000), done(4004), done(4005, 4000, 2000)]  # a circle with a branch
    rows += [done(5000, 5000), done(5001, 9999), (5002, [], 1, 6, True), done(5003, 5002), done(5004, 5003, 5001)]
    rows += [done(6000 + e, 2050) for e in range(200)]  # many that need the same
    got = states(spark, rows)
    assert got == plain(rows)
    assert got[1000] == "blocked" and got[2099] == "done" and got[3007] == "circle" and got[4002] == "done" and got[4001] == "circle"


def test_random_graphs(spark):
    r = random.Random(11)
    rows = []
    for g in range(40):  # forty small graphs at once
        n = r.randint(1, 9)
        for e in range(n):
            failed = r.random() < 0.15
            rows.append((100 * g + e, [100 * g + r.randrange(n + 1) for _ in range(r.choice([0, 1, 1, 1, 2]))], r.choice([0, 6]), 6, failed))
    assert states(spark, rows) == plain(rows)


def test_nothing(spark):
    assert states(spark, []) == {}
