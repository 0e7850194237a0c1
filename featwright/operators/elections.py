"""Elections over strict ballots: ``ballots(election_id, method, feature, feature_ord, rk)``, 1 = best.

Every election ranks all its candidates: the winner gets the next place and leaves,
and the election is held again. All ties go to the lower ``feature_ord``. A candidate that a ballot does not name is
last on it, after those it names, in order of ``feature_ord``.

A candidate is one row with its position on every ballot. Places are dealt out in blocks: which
candidates can win one of the next ``block`` places is read off the positions, exactly, and only those
meet in a task (at most ``block`` times the voters and one). Then the winners' positions are taken out
of all others', in chunks of candidates. There is one way for every size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featwright.functions.ranks import strict_positions, value_ranks
from featwright.storage import stage

_VOTER = ["election_id", "method"]
_CANDIDATE = "election_id string, feature string, feature_ord bigint, positions array<int>"
_WON = f"{_CANDIDATE}, place int"
#: Candidates whose positions one task lowers at once.
CHUNK = 100_000


def candidates(ballots: DataFrame) -> DataFrame:
    """One row per candidate: its positions on the ballots of its election, in order of the voters' names, without gaps; stored.

    ``ballots`` must be stored. A voter who names a candidate twice means the better place.
    """
    once = ballots.groupBy(*_VOTER, "feature", "feature_ord").agg((-F.min("rk")).alias("_back"))
    ranked = strict_positions(stage(once), _VOTER, "_back", "feature_ord")
    voters = ranked.groupBy("election_id").agg(F.sort_array(F.collect_set("method")).alias("_voters"))
    entries = F.collect_list(F.struct("method", F.col("rk").cast("int").alias("rk"))).alias("_entries")
    rows = ranked.groupBy("election_id", "feature", "feature_ord").agg(entries).join(voters, "election_id")
    named = F.transform("_voters", lambda v: F.get(F.filter("_entries", lambda e: e["method"] == v), F.lit(0))["rk"])
    rows = stage(rows.select("election_id", "feature", "feature_ord", named.alias("positions")))
    holes = rows.select("election_id", "feature_ord", F.posexplode("positions").alias("voter", "rk"))
    counted = holes.groupBy("election_id", "voter").agg(F.count("rk").alias("_named"))
    behind = value_ranks(holes.where("rk IS NULL"), ["election_id", "voter"], "feature_ord").join(counted, ["election_id", "voter"])
    position = (F.col("_named") + F.col("n_less") + 1).cast("int")
    filled = behind.groupBy("election_id", "feature_ord").agg(
        F.map_from_entries(F.collect_list(F.struct("voter", position.alias("rk")))).alias("_filled")
    )
    whole = F.transform("positions", lambda p, v: F.coalesce(p, F.col("_filled")[v]))
    return stage(rows.join(filled, ["election_id", "feature_ord"], "left").select("election_id", "feature", "feature_ord", whole.alias("positions")))


def _positions(group: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """The candidates in order of ``feature_ord`` and their positions, candidates × voters."""
    group = group.sort_values("feature_ord", ignore_index=True)[["election_id", "feature", "feature_ord", "positions"]]
    return group, np.stack(group.positions.to_numpy()).astype(np.int64)


def _without(positions: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Positions once the candidates at the positions ``gone`` have left."""
    out = positions.copy()
    for voter in range(positions.shape[1]):
        out[:, voter] -= np.searchsorted(np.sort(gone[:, voter]), positions[:, voter])
    return out


def _shrunken(left: DataFrame, gone: DataFrame, largest: int) -> DataFrame:
    """``left`` without the candidates ``gone``, its positions lowered by those of them in front; stored."""
    chunks = -(-largest // CHUNK)

    def lower(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        ours = ours[~ours.feature_ord.isin(theirs.feature_ord)]
        if len(ours) and len(theirs):
            new = _without(np.stack(ours.positions.to_numpy()), np.stack(theirs.positions.to_numpy()))
            ours = ours.assign(positions=list(new))
        return ours[["election_id", "feature", "feature_ord", "positions"]]

    dealt = left.withColumn("_chunk", F.pmod(F.xxhash64("feature_ord"), F.lit(chunks)).cast("int"))
    # named anew: both sides may come from one table
    own = [F.col(c).alias(c) for c in ("election_id", "feature_ord", "positions")]
    copies = gone.select(*own, F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("_chunk"))
    by = ["election_id", "_chunk"]
    return stage(dealt.groupBy(*by).cogroup(copies.groupBy(*by)).applyInPandas(lower, _CANDIDATE))


def _largest(pool: DataFrame) -> int:
    return pool.groupBy("election_id").count().agg(F.max("count")).first()[0] or 0


def _ranking(ballots: DataFrame, block: int, pool_of: Callable[[DataFrame], DataFrame], winners: Callable[[np.ndarray], Iterator[int]]) -> DataFrame:
    """Places block by block. ``winners`` yields the next winner's row among a block's candidates, again and again."""

    def places(first: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(group: pd.DataFrame) -> pd.DataFrame:
            group, positions = _positions(group)
            order = list(islice(winners(positions), block))
            return group.iloc[order].assign(place=range(first, first + len(order)))

        return run

    left = candidates(ballots)
    size, first, found = _largest(left), 1, []
    while size > 0:
        won = stage(pool_of(left).groupBy("election_id").applyInPandas(places(first), _WON))
        found.append(won.select("election_id", "feature", "place"))
        size, first = size - block, first + block
        if size > 0:
            left = _shrunken(left, won, size + block)
    return reduce(DataFrame.unionAll, found) if found else left.select("election_id", "feature", F.lit(0).alias("place"))


# ---- instant runoff --------------------------------------------------------


def _runoff(choices: list[list[int]], pool: list[int], together: bool) -> int:
    """The winner among ``pool``, who are all somebody's first choice; ``choices`` are their positions by voter."""
    alive = list(range(len(pool)))
    head = [min(alive, key=own.__getitem__) for own in choices]
    while True:
        votes = Counter(head)
        most = max(votes.values())
        if 2 * most > len(head) or len(alive) == 1:
            return pool[min(c for c in alive if votes[c] == most)]
        least = min(votes[c] for c in alive)
        last = [c for c in alive if votes[c] == least]
        if together and len(last) == len(alive):
            return pool[alive[0]]
        leaving = set(last) if together else {last[-1]}
        alive = [c for c in alive if c not in leaving]
        # only the ballots of those who leave move on
        head = [min(alive, key=choices[v].__getitem__) if c in leaving else c for v, c in enumerate(head)]


def _runoff_winners(together: bool) -> Callable[[np.ndarray], Iterator[int]]:
    """Each ballot keeps a pointer to its first candidate that is left; nobody else gets a vote.

    Whoever is nobody's first choice leaves before all others, so that an election is one among the heads.
    """

    def run(positions: np.ndarray) -> Iterator[int]:
        ballots = [positions[:, v].argsort().tolist() for v in range(positions.shape[1])]
        rows = positions.tolist()
        gone = [False] * len(rows)
        pointer = [0] * len(ballots)
        for _ in rows:
            pool = sorted({ballot[p] for ballot, p in zip(ballots, pointer)})
            winner = _runoff([[rows[c][v] for c in pool] for v in range(len(ballots))], pool, together)
            gone[winner] = True
            yield winner
            for v, ballot in enumerate(ballots):
                while pointer[v] < len(ballot) and gone[ballot[pointer[v]]]:
                    pointer[v] += 1

    return run


def _fronts(block: int) -> Callable[[DataFrame], DataFrame]:
    """Candidates that some voter has among the first ``block``: a head is among the first i + 1 when i are gone."""
    return lambda left: left.where(F.array_min("positions") <= block)


def elect_instant_runoff(ballots: DataFrame, block: int = 50_000) -> DataFrame:
    """Rank all by repeated instant runoff; the one lowest candidate leaves in each round."""
    return _ranking(ballots, block, _fronts(block), _runoff_winners(together=False))


def elect_instant_runoff_simultaneous(ballots: DataFrame, block: int = 50_000) -> DataFrame:
    """Rank all by repeated instant runoff; all lowest candidates leave together."""
    return _ranking(ballots, block, _fronts(block), _runoff_winners(together=True))


# ---- Bucklin ---------------------------------------------------------------

_SWEEP = 64  # places between two looks at all candidates of a set; sweeps of many places are made of shorter ones


def _levels(positions: np.ndarray) -> np.ndarray:
    """The depth at which each candidate has a majority: an order statistic of its positions."""
    half = positions.shape[1] // 2
    return np.partition(positions, half, axis=1)[:, half]


def _one_by_one(positions: np.ndarray, n: int) -> list[int]:
    """The rows of the next ``n`` winners. Rows are in order of feature_ord, the first of equals wins."""
    rows = np.arange(len(positions))
    taken = []
    for _ in range(n):
        level = _levels(positions)
        votes = (positions <= level[:, None]).sum(axis=1)
        best = int((level * (positions.shape[1] + 1) - votes).argmin())
        taken.append(int(rows[best]))
        positions = np.delete(positions - (positions > positions[best]), best, axis=0)
        rows = np.delete(rows, best)
    return taken


def _bucklin_winners(positions: np.ndarray, sweep: int | None = None) -> Iterator[int]:
    """Sweeps: when j are gone a level is at most j lower, so that few candidates can win one of the next places.

    A sweep of many places is held among those few, in shorter sweeps, so that all candidates are seldom looked at.
    """
    rows = np.arange(len(positions))
    if sweep is None:
        sweep = _SWEEP
        while sweep * _SWEEP < len(rows):
            sweep *= _SWEEP
    while len(rows):
        levels = _levels(positions)
        n = min(sweep, len(rows))
        near = np.flatnonzero(levels <= np.partition(levels, n - 1)[n - 1] + n - 1)
        own = positions[near]
        taken = near[_one_by_one(own, n) if sweep == _SWEEP else list(islice(_bucklin_winners(own, sweep // _SWEEP), n))]
        yield from rows[taken].tolist()
        gone = positions[taken]
        positions = _without(np.delete(positions, taken, axis=0), gone)
        rows = np.delete(rows, taken)


def elect_bucklin(ballots: DataFrame, block: int = 100_000) -> DataFrame:
    """Rank all by repeated Bucklin elections: smallest depth with a majority, most votes at it.

    A candidate that wins one of the next k places has a depth of at most k - 1 more than the k-th
    smallest. A depth is the position of a candidate on some ballot, so that at most a few voters' worth share one.
    """

    def near(left: DataFrame) -> DataFrame:
        middle = F.floor(F.size("positions") / 2).cast("int")
        levelled = stage(left.withColumn("_level", F.get(F.array_sort("positions"), middle)))
        ranks = value_ranks(levelled.select("election_id", "_level"), ["election_id"], "_level")
        bound = ranks.where(F.col("n_less") < block).groupBy("election_id").agg((F.max("_level") + block - 1).alias("_bound"))
        return levelled.join(bound, "election_id").where("_level <= _bound").drop("_level", "_bound")

    return _ranking(ballots, block, near, _bucklin_winners)


# ---- Coombs ----------------------------------------------------------------


def _first_later(times: np.ndarray, k: int, time: int) -> int:
    """The first place from ``k`` on whose time is above ``time``, in steps of growing length; the length if there is none."""
    step = 32
    while k < len(times):
        found = times[k : k + step] > time
        i = int(found.argmax())
        if found[i]:
            return k + i
        k, step = k + step, 4 * step
    return len(times)


def _last_equal(times: np.ndarray, k: int, time: int) -> int:
    """The last place up to ``k`` whose time is ``time``; -1 if there is none."""
    step = 32
    while k >= 0:
        low = max(0, k - step + 1)
        found = times[low : k + 1][::-1] == time
        i = int(found.argmax())
        if found[i]:
            return k - i
        k, step = low - 1, 4 * step
    return -1


class _Eliminations:
    """The log of a Coombs election's eliminations and the first choices it leads to, kept from place to place.

    Who leaves depends on the last places only. So when a winner is taken out, the log stays right up to
    the time when that winner first stood last on a ballot: only what follows is undone and held again.

    A ballot's first choices in the course of the log are those that leave later than all in front of them. They are kept
    as a stack, whose top is the first choice now, each with the time since when it is. Undoing and winning take from
    the top only, so that a stack changes by a few entries a place. A candidate has a majority from the
    time on when it is on top for enough ballots; the earliest such time is kept in a heap.
    """

    def __init__(self, positions: np.ndarray):
        n, voters = positions.shape
        order = [positions[:, v].argsort() for v in range(voters)]
        self.ballots = [ballot.tolist() for ballot in order]
        self.place = [np.argsort(ballot) for ballot in order]
        self.gone = [False] * n
        self.never = n + 1
        self.out = [self.never] * n  # number of the elimination, if any
        self.times = [np.full(n, self.never, np.int32) for _ in order]  # the same by place on a ballot; 0: gone
        self.log: list[int] = []
        self.tail = [n - 1] * voters
        self.stood: dict[int, int] = {}  # eliminations before a candidate first stood last
        self.order: list[int] = []
        self.front = [0] * voters  # all in front of it are gone
        self.heads: list[list[tuple[int, int]]] = [[] for _ in order]  # (candidate, since when) of each ballot
        self.needed = voters // 2 + 1
        self.since: dict[int, list[int]] = {}  # since when a candidate is first choice, of all ballots that it leads
        self.majorities: list[tuple[int, int]] = []  # heap of (time, candidate); holds outdated ones too
        for v in range(voters):
            self._lead(v)
        self._note()

    def _note(self) -> None:
        """Move the tails to candidates that are left."""
        for v, ballot in enumerate(self.ballots):
            k = self.tail[v]
            if k >= 0 and (self.gone[ballot[k]] or self.out[ballot[k]] < self.never):
                k = self.tail[v] = _last_equal(self.times[v], k, self.never)
            if k >= 0 and ballot[k] not in self.stood:
                self.stood[ballot[k]] = len(self.log)
                self.order.append(ballot[k])

    def _lead(self, v: int) -> None:
        """Prolong a ballot's first choices up to the one that is left."""
        heads, times = self.heads[v], self.times[v]
        while not heads or self.out[heads[-1][0]] < self.never:
            if heads:
                time = self.out[heads[-1][0]]
                k = _first_later(times, int(self.place[v][heads[-1][0]]) + 1, time)
            else:
                time = 0
                k = self.front[v] = _first_later(times, self.front[v], 0)
            if k == len(times):
                break
            c = self.ballots[v][k]
            heads.append((c, time))
            self.since.setdefault(c, []).append(time)
            self._majority(c)

    def _drop_head(self, v: int) -> None:
        c, time = self.heads[v].pop()
        self.since[c].remove(time)
        self._majority(c)

    def _majority_since(self, c: int) -> int | None:
        times = self.since[c]
        return sorted(times)[self.needed - 1] if len(times) >= self.needed else None

    def _majority(self, c: int) -> None:
        time = self._majority_since(c)
        if time is not None:
            heappush(self.majorities, (time, c))

    def eliminate(self) -> None:
        """Whoever is last most often leaves; among equals the one with the highest number."""
        lasts: dict[int, int] = {}
        for ballot, k in zip(self.ballots, self.tail):
            lasts[ballot[k]] = lasts.get(ballot[k], 0) + 1
        loser = max(zip(lasts.values(), lasts))[1]
        self.log.append(loser)
        self.out[loser] = len(self.log)
        for v, times in enumerate(self.times):
            times[self.place[v][loser]] = len(self.log)
        for v, heads in enumerate(self.heads):
            if heads[-1][0] == loser:
                self._lead(v)
        self._note()

    def winner(self, steps: int | None = None) -> int | None:
        """The first with a majority; the log is prolonged until there is one (None: it is not after ``steps`` eliminations)."""
        while True:
            while self.majorities:
                time, c = self.majorities[0]
                if self._majority_since(c) == time:
                    return c
                heappop(self.majorities)
            if steps is not None and len(self.log) >= steps:
                return None
            self.eliminate()

    def take_out(self, winner: int) -> None:
        self.gone[winner] = True
        since = self.stood.get(winner)
        undone = [] if since is None else self.log[since:]
        if undone:
            del self.log[since:]
            for c in undone:
                self.out[c] = self.never
            for v, place in enumerate(self.place):
                back = place[undone]
                self.times[v][back] = self.never
                self.tail[v] = max(self.tail[v], int(back.max()))
                heads = self.heads[v]
                while len(heads) > 1 and self.out[heads[-2][0]] == self.never:
                    self._drop_head(v)
        # who is left and leads a ballot is on top
        for v, heads in enumerate(self.heads):
            self.times[v][self.place[v][winner]] = 0
            if heads and heads[-1][0] == winner:
                self._drop_head(v)
                self._lead(v)
        if since is not None:
            while self.order and self.stood[self.order[-1]] > since:
                del self.stood[self.order.pop()]
            self._note()


def _coombs_winners(positions: np.ndarray) -> Iterator[int]:
    election = _Eliminations(positions)
    for _ in range(len(positions)):
        winner = election.winner()
        yield winner
        election.take_out(winner)


def _coombs_steps(positions: np.ndarray, steps: int) -> tuple[int | None, list[int]]:
    """The winner, or the first ``steps`` eliminations if there is none so far."""
    election = _Eliminations(positions)
    return election.winner(steps), election.log


def elect_coombs(ballots: DataFrame, block: int = 500_000) -> DataFrame:
    """Rank all by repeated Coombs elections: a majority of first places wins, else whoever is last most often leaves.

    An election of up to ``block`` candidates is held in one task from its first place to its last. In a larger one a job
    makes up to ``block`` eliminations on both ends of the ballots, which no more of them can reach past, until a
    majority; the winner leaves for good, the eliminated come back, and so on until ``block`` candidates are left.
    """
    pool = candidates(ballots)
    running = pool
    found: DataFrame | None = None
    while True:
        sizes = pool.groupBy("election_id").agg(F.count("*").alias("_whole"))
        alive = running.groupBy("election_id").agg(F.count("*").alias("_left"))
        counts = stage(sizes.join(alive, "election_id"))
        largest = counts.agg(F.max("_whole")).first()[0]
        if not largest:
            break
        ends = (F.array_min("positions") <= block + 1) | (F.array_max("positions") > F.col("_left") - block - 1)

        def hold(group: pd.DataFrame) -> pd.DataFrame:
            whole = int(group._whole.iloc[0])
            group, positions = _positions(group)
            if whole <= block and whole == len(group):
                order = list(_coombs_winners(positions))
                return group.iloc[order].assign(place=range(1, whole + 1))
            winner, out = _coombs_steps(positions, block)
            # 0: eliminated for now, -1: the winner
            return group.iloc[out].assign(place=0) if winner is None else group.iloc[[winner]].assign(place=-1)

        near = running.join(counts, "election_id").where(ends)
        outcome = stage(near.groupBy("election_id").applyInPandas(hold, _WON))
        before = F.lit(0)
        ranked = outcome.where("place <> 0")
        if found is not None:
            taken = found.groupBy("election_id").agg(F.count("*").alias("_taken"))
            ranked, before = ranked.join(taken, "election_id", "left"), F.coalesce("_taken", F.lit(0))
        placed = ranked.select("election_id", "feature", "feature_ord", (F.abs("place") + before).cast("int").alias("place"))
        found = stage(placed if found is None else found.unionAll(placed))
        if largest <= block:
            unfinished = outcome.where("place <= 0")
            if unfinished.isEmpty():
                break
        # winners leave the pool; a decided election starts again with all that are left in it
        pool_gone = pool.join(found.select("election_id", "feature_ord"), ["election_id", "feature_ord"], "left_semi")
        new_pool = _shrunken(pool, pool_gone, largest)
        decided = outcome.where("place <> 0").select("election_id").distinct()
        going_on = running.join(decided, "election_id", "left_anti")
        pool, running = new_pool, stage(
            _shrunken(going_on, outcome.where("place = 0"), largest).unionAll(new_pool.join(decided, "election_id", "left_semi"))
        )
    return found.select("election_id", "feature", "place") if found is not None else pool.select("election_id", "feature", F.lit(0).alias("place"))
