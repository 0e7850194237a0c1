"""Elections per brand: the places of all parts, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from featwright.operators import elections as V
from workload import inputs
from workload.score_queries import BALLOTS


def _query(elect):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ballots = inputs.ballots(inputs.brand_votes(spark, sf_dir))
        return elect(ballots)

    return run


def queries() -> dict:
    return {
        "elect_instant_runoff": _query(V.elect_instant_runoff),
        "elect_instant_runoff_simultaneous": _query(V.elect_instant_runoff_simultaneous),
        "elect_coombs": _query(V.elect_coombs),
        "elect_bucklin": _query(V.elect_bucklin),
    }


# ---- the same in SQL: a recursion over the rounds ------------------------------
# Ballots are lists of feature numbers, best first. ``keyed`` numbers carry a
# count and a feature number, so that one min or max settles ties.

LISTS = BALLOTS + """,
per_voter AS (SELECT election_id, method, list(feature_ord ORDER BY rk) AS ballot FROM ballots GROUP BY 1, 2),
papers AS (SELECT election_id, list(ballot ORDER BY method) AS papers FROM per_voter GROUP BY 1)"""

_BIG = 1000000000000


def _count(of: str, choices: str) -> str:
    return f"len(list_filter({choices}, lambda u: u = {of}))"


def _finish(state: str) -> str:
    names = "(SELECT DISTINCT election_id, feature, feature_ord FROM ballots) n"
    return (
        " SELECT s.election_id, n.feature, s.place FROM (SELECT r.election_id, unnest(winners) AS feature_ord,"
        f" CAST(generate_subscripts(winners, 1) AS INTEGER) AS place FROM {state} r JOIN papers USING (election_id)"
        f" WHERE len(winners) = len(papers[1])) s JOIN {names} USING (election_id, feature_ord)"
    )


def _runoff_sql(together: bool) -> str:
    """State: the winners so far and who is still in the running (NULL at the start of a place)."""
    key = f"{_count('t', 'heads')} * {_BIG} - t"  # fewest votes first, then the higher number
    if together:
        leaves = (
            f"CASE WHEN list_min(counts) = list_max(counts) THEN [list_min(heads)]"
            f" ELSE list_distinct(list_filter(heads, lambda t: {_count('t', 'heads')} > list_min(counts))) END"
        )
    else:
        worst = f"list_min(list_transform(heads, lambda t: {key}))"
        leaves = f"list_distinct(list_filter(heads, lambda t: {key} <> {worst}))"
    return f"""WITH RECURSIVE {LISTS},
rounds AS (
  SELECT election_id, CAST([] AS BIGINT[]) AS winners, CAST(NULL AS BIGINT[]) AS alive FROM papers
  UNION ALL
  SELECT election_id,
         CASE WHEN len(list_distinct(heads)) = 1 THEN list_append(winners, heads[1]) ELSE winners END,
         CASE WHEN len(list_distinct(heads)) = 1 THEN NULL ELSE {leaves} END
  FROM (SELECT *, list_transform(heads, lambda t: {_count('t', 'heads')}) AS counts FROM (
    SELECT r.election_id, winners, list_transform(papers, lambda p: list_filter(p, lambda x:
             CASE WHEN alive IS NULL THEN NOT list_contains(winners, x) ELSE list_contains(alive, x) END)[1]) AS heads
    FROM rounds r JOIN papers USING (election_id) WHERE len(winners) < len(papers[1])))
)""" + _finish("rounds")


def _coombs_sql() -> str:
    """State: the winners so far and who is out of the running for the present place."""
    head_votes = f"list_transform(heads, lambda t: {_count('t', 'heads')})"
    loser = f"list_max(list_transform(tails, lambda t: {_count('t', 'tails')} * {_BIG} + t)) % {_BIG}"
    top = f"list_max(list_transform(heads, lambda t: {_count('t', 'heads')} * {_BIG} + t)) % {_BIG}"
    return f"""WITH RECURSIVE {LISTS},
rounds AS (
  SELECT election_id, CAST([] AS BIGINT[]) AS winners, CAST([] AS BIGINT[]) AS outs FROM papers
  UNION ALL
  SELECT election_id,
         CASE WHEN decided THEN list_append(winners, {top}) ELSE winners END,
         CASE WHEN decided THEN CAST([] AS BIGINT[]) ELSE list_append(outs, {loser}) END
  FROM (SELECT *, list_max({head_votes}) * 2 > len(heads) AS decided FROM (
    SELECT election_id, winners, outs, list_transform(remaining, lambda p: p[1]) AS heads,
           list_transform(remaining, lambda p: p[len(p)]) AS tails
    FROM (SELECT r.election_id, winners, outs, list_transform(papers, lambda p: list_filter(p, lambda x:
            NOT list_contains(winners, x) AND NOT list_contains(outs, x))) AS remaining
          FROM rounds r JOIN papers USING (election_id) WHERE len(winners) < len(papers[1]))))
)""" + _finish("rounds")


def _bucklin_sql() -> str:
    """State: the winners so far. A key holds depth, votes at it and the number of a candidate."""
    majority = "len(ps) // 2 + 1"
    key = f"(list_sort(ps)[{majority}] * 1000 - len(list_filter(ps, lambda q: q <= list_sort(ps)[{majority}]))) * {_BIG} + c"
    return f"""WITH RECURSIVE {LISTS},
rounds AS (
  SELECT election_id, CAST([] AS BIGINT[]) AS winners FROM papers
  UNION ALL
  SELECT election_id, list_append(any_value(winners), min({key}) % {_BIG})
  FROM (
    SELECT election_id, winners, c, list_transform(remaining, lambda r: list_position(r, c)) AS ps
    FROM (SELECT *, unnest(remaining[1]) AS c FROM (
      SELECT r.election_id, winners, list_transform(papers, lambda p: list_filter(p, lambda x: NOT list_contains(winners, x))) AS remaining
      FROM rounds r JOIN papers USING (election_id) WHERE len(winners) < len(papers[1]))))
  GROUP BY election_id
)""" + _finish("rounds")


def oracle_sql() -> dict[str, str]:
    return {
        "elect_instant_runoff": _runoff_sql(False),
        "elect_instant_runoff_simultaneous": _runoff_sql(True),
        "elect_coombs": _coombs_sql(),
        "elect_bucklin": _bucklin_sql(),
    }
