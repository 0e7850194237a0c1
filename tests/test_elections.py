"""Elections against plain reference rules on small random ballots."""

import sys

import numpy as np
import pandas as pd
import pytest

from featwright.operators import elections as V


def _head(order, alive):
    return next(c for c in order if c in alive)


def _tail(order, alive):
    return next(c for c in reversed(order) if c in alive)


def _runoff(orders, pool, together):
    alive = set(pool)
    while True:
        votes = {c: 0 for c in alive}
        for o in orders:
            votes[_head(o, alive)] += 1
        leader = min(alive, key=lambda c: (-votes[c], c))
        if votes[leader] * 2 > len(orders) or len(alive) == 1:
            return leader
        low = min(votes.values())
        lows = [c for c in alive if votes[c] == low]
        if together:
            if len(lows) == len(alive):
                return min(alive)
            alive -= set(lows)
        else:
            alive.remove(max(lows))


def _coombs(orders, pool):
    alive = set(pool)
    while True:
        votes = {c: sum(_head(o, alive) == c for o in orders) for c in alive}
        leader = min(alive, key=lambda c: (-votes[c], c))
        if votes[leader] * 2 > len(orders) or len(alive) == 1:
            return leader
        lasts = {c: sum(_tail(o, alive) == c for o in orders) for c in alive}
        alive.remove(max(alive, key=lambda c: (lasts[c], c)))


def _bucklin(orders, pool):
    left = [[c for c in o if c in pool] for o in orders]
    for level in range(1, len(pool) + 1):
        votes = {c: sum(c in o[:level] for o in left) for c in pool}
        leader = min(pool, key=lambda c: (-votes[c], c))
        if votes[leader] * 2 > len(orders):
            return leader


RULES = {
    V.elect_instant_runoff: lambda o, p: _runoff(o, p, False),
    V.elect_instant_runoff_simultaneous: lambda o, p: _runoff(o, p, True),
    V.elect_coombs: _coombs,
    V.elect_bucklin: _bucklin,
}


@pytest.fixture(scope="module")
def polls(spark):
    rng = np.random.default_rng(11)
    rows, orders = [], {}
    for e in range(6):
        n, voters = 9, 4 + e % 3
        papers = [list(rng.permutation(n)) for _ in range(voters)]
        if e == 5:  # all voters agree but one
            papers = [list(range(n))] * 4 + [list(range(n))[::-1]]
        orders[f"e{e}"] = papers
        for v, paper in enumerate(papers):
            rows += [(f"e{e}", f"v{v}", f"f{c}", int(c), rk + 1) for rk, c in enumerate(paper)]
    frame = pd.DataFrame(rows, columns=["election_id", "method", "feature", "feature_ord", "rk"])
    return orders, spark.createDataFrame(frame)


def _want(orders, rule, k):
    places = set()
    for election, papers in orders.items():
        pool = set(range(len(papers[0])))
        for place in range(1, k + 1):
            winner = rule(papers, pool)
            pool.remove(winner)
            places.add((election, f"f{winner}", place))
    return places


def _got(df):
    rows = [(r.election_id, r.feature, r.place) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("elect", RULES)
@pytest.mark.parametrize("block", [1000, 4])
def test_complete_ranking(polls, elect, block):
    """Whole rankings of all elections; in one block, and in blocks that hold a part of the candidates."""
    orders, ballots = polls
    if block < 1000:
        orders = {e: orders[e] for e in ("e1", "e5")}
        ballots = ballots.where("election_id in ('e1', 'e5')")
    assert _got(elect(ballots, block=block)) == _want(orders, RULES[elect], 9)


@pytest.mark.parametrize("elect", RULES)
def test_many_candidates_in_a_task(elect):
    """The algorithms inside a task against the plain rules, on ballots that agree in part."""
    rng = np.random.default_rng(5)
    inside = {
        V.elect_instant_runoff: V._runoff_winners(False),
        V.elect_instant_runoff_simultaneous: V._runoff_winners(True),
        V.elect_coombs: V._coombs_winners,
        V.elect_bucklin: V._bucklin_winners,
    }[elect]
    for n, voters, noise in ((60, 5, 100), (90, 4, 10), (150, 3, 30), (40, 7, 3), (30, 1, 5), (1, 2, 1)):
        quality = np.arange(n)
        papers = [np.argsort(quality + rng.normal(0, noise, n)).tolist() for _ in range(voters)]
        positions = np.empty((n, voters), np.int64)
        for v, paper in enumerate(papers):
            positions[paper, v] = np.arange(1, n + 1)
        pool, want = set(range(n)), []
        while pool:
            want.append(RULES[elect](papers, pool))
            pool.remove(want[-1])
        assert list(inside(positions)) == want


@pytest.mark.parametrize("elect", RULES)
def test_a_ballot_that_lacks_a_candidate(spark, elect):
    """Who is not on a ballot is last there, not first."""
    papers = {"m1": "ac", "m2": "ac", "m3": "bac"}
    rows = [("e", m, f, ord(f), k + 1) for m, paper in papers.items() for k, f in enumerate(paper)]
    ballots = spark.createDataFrame(rows, "election_id string, method string, feature string, feature_ord long, rk int")
    whole = {"m1": "acb", "m2": "acb", "m3": "bac"}
    orders = [[ord(c) for c in whole[m]] for m in papers]
    pool, want = set(orders[0]), []
    while pool:
        want.append(RULES[elect](orders, pool))
        pool.remove(want[-1])
    assert _got(elect(ballots)) == {("e", chr(c), k + 1) for k, c in enumerate(want)}
    assert want[0] == ord("a")


def test_no_ballots(polls):
    _, ballots = polls
    for elect in RULES:
        assert elect(ballots.limit(0)).collect() == []


def test_coombs_keeps_first_choices_from_place_to_place():
    """A place costs a few steps, not a walk through all eliminations: such walks took minutes here."""
    n = 6_000
    rng = np.random.default_rng(8)
    quality = rng.normal(0, 1, n)
    positions = np.empty((n, 5), np.int64)
    for v in range(5):
        positions[np.argsort(quality * 2 + rng.normal(0, 1, n)), v] = np.arange(1, n + 1)
    steps = 0

    def count(frame, event, arg):
        nonlocal steps
        steps += 1

    sys.setprofile(count)
    try:
        order = list(V._coombs_winners(positions))
    finally:
        sys.setprofile(None)
    assert sorted(order) == list(range(n))
    assert steps < 1_400 * n


def test_bucklin_sweeps_inside_sweeps(monkeypatch):
    """Few looks at all candidates: sweeps of many places are made of shorter ones, with the same winners."""
    n, rows = 700, 0
    rng = np.random.default_rng(2)
    positions = np.empty((n, 5), np.int64)
    for v in range(5):
        positions[np.argsort(np.arange(n) + rng.normal(0, 60, n)), v] = np.arange(1, n + 1)
    levels = V._levels

    def count(of):
        nonlocal rows
        rows += len(of)
        return levels(of)

    want = V._one_by_one(positions, n)
    monkeypatch.setattr(V, "_levels", count)
    monkeypatch.setattr(V, "_SWEEP", 5)
    assert list(V._bucklin_winners(positions)) == want
    assert rows < 50 * n
