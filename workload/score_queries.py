"""Queries over scores, votes and aggregators, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featwright.functions.expressions import rounded
from featwright.operators import scores as S
from featwright.operators.aggregate import AGGREGATORS, MEASURES, aggregate_votes
from featwright.plans.ensemble import cv_aggregate
from featwright.settings import Settings
from workload import inputs

MILLION = 1_000_000
_IN_MILLIONTHS = {"Sum", "ArithmeticMean", "Median", "Min", "Max", "WeightedAveraging"}

AGGREGATOR_KEYS = {
    "agg_sum": "Sum",
    "agg_mean": "ArithmeticMean",
    "agg_geomean": "GeometricMean",
    "agg_median": "Median",
    "agg_count": "Count",
    "agg_min": "Min",
    "agg_max": "Max",
    "agg_weighted": "WeightedAveraging",
    "agg_borda": "BordaCount",
    "agg_reciprocal": "ReciprocalRanking",
    "agg_topn_frequency": "FeatureOccurrenceFrequency",
}
AGGREGATOR_KEYS |= {f"{k}_ranked": f"{n}Ranked" for k, n in AGGREGATOR_KEYS.items()}
assert sorted(AGGREGATOR_KEYS.values()) == sorted(AGGREGATORS)
TOP_N = 20


def _score(df: DataFrame) -> DataFrame:
    return df.withColumn("score", rounded(F.col("score")))


def aggregator_query(name: str):
    base = name.removesuffix("Ranked")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        votes = inputs.brand_votes(spark, sf_dir)
        unit = MILLION
        if base == "GeometricMean":  # reads ranks, not scores
            votes = inputs.ballots(votes).withColumnRenamed("rk", "score")
            unit = 1
        weights = None
        if base == "WeightedAveraging":
            weights = votes.groupBy("method").agg((F.sum("score") / F.count("*")).alias("acc"))
        table = aggregate_votes(
            votes, [name], top_n=TOP_N, unit=unit, method_weights=weights, decimals=6, stored=True
        )
        value = F.col(name)
        if name in _IN_MILLIONTHS:
            value = rounded(value / MILLION)
        return table.select("election_id", "feature", value.alias("value"))

    return run


# ---- the same in SQL -------------------------------------------------------

_NAME = "CASE WHEN {k} % 7 = 0 THEN 'bm_' ELSE 'p_' END || CAST({k} AS VARCHAR)"
_PCT = "CAST(floor({c} * 100 + 0.5) AS BIGINT)"


def pct(column: str) -> str:
    return _PCT.format(c=column)


def feature(column: str) -> str:
    return _NAME.format(k=column)


def q6(expression: str) -> str:
    return f"floor(({expression}) * 1000000 + 0.5001) / 1000000.0::DOUBLE"


LINE_SCORES = f"""
parts_seen AS (SELECT DISTINCT l_partkey FROM lineitem),
folds AS (SELECT DISTINCT l_linenumber FROM lineitem),
per_fold AS (
  SELECT l_partkey, l_linenumber, sum(l_quantity) AS sum_quantity,
         CAST(sum({pct('l_extendedprice')}) AS DOUBLE) / count(*) AS avg_price,
         CAST(sum({pct('l_discount')}) AS DOUBLE) / count(*) AS avg_discount,
         CAST(count(*) AS DOUBLE) AS line_count, max(l_tax) AS max_tax
  FROM lineitem GROUP BY 1, 2),
dense AS (
  SELECT p.l_partkey, f.l_linenumber - 1 AS outer_fold,
         coalesce(sum_quantity, 0) AS sum_quantity, coalesce(avg_price, 0) AS avg_price,
         coalesce(avg_discount, 0) AS avg_discount, coalesce(line_count, 0) AS line_count,
         coalesce(max_tax, 0) AS max_tax
  FROM parts_seen p CROSS JOIN folds f LEFT JOIN per_fold x
    ON x.l_partkey = p.l_partkey AND x.l_linenumber = f.l_linenumber),
long AS (
  SELECT l_partkey, outer_fold, 'sum_quantity' AS method, sum_quantity AS score FROM dense
  UNION ALL SELECT l_partkey, outer_fold, 'avg_price', avg_price FROM dense
  UNION ALL SELECT l_partkey, outer_fold, 'avg_discount', avg_discount FROM dense
  UNION ALL SELECT l_partkey, outer_fold, 'line_count', line_count FROM dense
  UNION ALL SELECT l_partkey, outer_fold, 'max_tax', max_tax FROM dense),
line_scores AS (
  SELECT method, outer_fold, l_partkey AS feature_ord, {feature('l_partkey')} AS feature,
         CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END AS score
  FROM (SELECT *, min(score) OVER (PARTITION BY method, outer_fold) AS lo,
                  max(score) OVER (PARTITION BY method, outer_fold) AS hi FROM long))"""

CV_SCORES = LINE_SCORES + """,
cv_mean AS (SELECT method, feature_ord, feature, avg(score) AS score FROM line_scores GROUP BY 1, 2, 3),
cv_scores AS (
  SELECT method, feature_ord, feature,
         CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END AS score
  FROM (SELECT *, min(score) OVER (PARTITION BY method) AS lo,
                  max(score) OVER (PARTITION BY method) AS hi FROM cv_mean))"""

BRAND_VOTES = CV_SCORES + """,
votes AS (
  SELECT p_brand AS election_id, feature, feature_ord, method,
         CAST(floor(score * 1000000 + 0.5001) AS BIGINT) AS score
  FROM cv_scores JOIN part ON p_partkey = feature_ord)"""

LINE_VOTES = CV_SCORES + """,
votes AS (
  SELECT 'all' AS election_id, feature, feature_ord, method,
         CAST(floor(score * 1000000 + 0.5001) AS BIGINT) AS score
  FROM cv_scores)"""

BALLOTS = BRAND_VOTES + """,
ballots AS (
  SELECT election_id, method, feature, feature_ord,
         row_number() OVER (PARTITION BY election_id, method ORDER BY score DESC, feature_ord) AS rk
  FROM votes)"""

VOTER_RANKS = """,
voter_ranks AS (
  SELECT *, rank() OVER (PARTITION BY election_id, method ORDER BY score DESC) AS low_rank,
         rank() OVER (PARTITION BY election_id, method ORDER BY score DESC)
           + (count(*) OVER (PARTITION BY election_id, method, score) - 1) / 2.0::DOUBLE AS mean_rank
  FROM votes)"""

WEIGHTS = """,
acc AS (SELECT method, CAST(sum(score) AS DOUBLE) / count(*) AS acc FROM votes GROUP BY 1),
weights AS (SELECT method, acc / sum(acc) OVER () AS w FROM acc)"""

_FOLD_SQL = {
    "sum": "CAST(sum(score) AS DOUBLE)",
    "mean": "avg(score)",
    "geomean": "exp(avg(ln(score)))",
    "median": "CAST(median(score) AS DOUBLE)",
    "count": "CAST(count(*) FILTER (WHERE score <> 0) AS DOUBLE)",
    "min": "CAST(min(score) AS DOUBLE)",
    "max": "CAST(max(score) AS DOUBLE)",
    "weighted": "sum(w * score) / count(*)",
    "borda": "sum(mean_rank)",
    "reciprocal": "1.0 / sum(1.0 / mean_rank)",
    "topn": f"CAST(count(*) FILTER (WHERE low_rank <= {TOP_N}) AS DOUBLE)",
}


def _mean_rank(x: str, direction: str) -> str:
    return (
        f"CAST(rank() OVER (PARTITION BY election_id ORDER BY {x} {direction}) "
        f"+ (count(*) OVER (PARTITION BY election_id, {x}) - 1) / 2.0::DOUBLE AS DOUBLE)"
    )


def aggregator_sql(name: str) -> str:
    base = name.removesuffix("Ranked")
    measure = MEASURES[base]
    body = "WITH " + BRAND_VOTES
    source, unit = "votes", MILLION
    if base == "GeometricMean":
        body = "WITH " + BALLOTS
        source, unit = "(SELECT election_id, feature, rk AS score FROM ballots)", 1
    if measure.from_ranks:
        body += VOTER_RANKS
        source = "voter_ranks"
    if base == "WeightedAveraging":
        body += WEIGHTS
        source = "votes JOIN weights USING (method)"
    fold = _FOLD_SQL[measure.fold]
    if not measure.exact:
        fold = q6(fold)
    body += f",\nmeasured AS (SELECT election_id, feature, {fold} AS x FROM {source} GROUP BY 1, 2)"
    if not name.endswith("Ranked"):
        x = q6(f"x / {MILLION}") if name in _IN_MILLIONTHS else "x"
        return body + f"\nSELECT election_id, feature, {x} AS value FROM measured"
    if measure.ranked == "by_values":
        value = (
            f"CASE WHEN max(x) OVER (PARTITION BY election_id) <= {unit} "
            f"THEN {_mean_rank('x', 'DESC')} ELSE {_mean_rank('x', 'ASC')} END"
        )
    else:
        value = _mean_rank("x", "DESC" if measure.ranked == "desc" else "ASC")
    return body + f"\nSELECT election_id, feature, {value} AS value FROM measured"


# ---- flagship --------------------------------------------------------------


def ensemble_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = Settings().ensemble_aggregators
    table = aggregate_votes(
        inputs.line_votes(spark, sf_dir), names, top_n=TOP_N, unit=MILLION, decimals=6, stored=True
    )
    columns = [
        (rounded(F.col(n) / MILLION) if n in _IN_MILLIONTHS else F.col(n)).alias(n) for n in names
    ]
    return table.select("feature", *columns)


def _ensemble_sql() -> str:
    names = Settings().ensemble_aggregators
    bases = list(dict.fromkeys(n.removesuffix("Ranked") for n in names))
    folds = ",\n         ".join(
        f"{_FOLD_SQL[MEASURES[b].fold] if MEASURES[b].exact else q6(_FOLD_SQL[MEASURES[b].fold])} AS {b}"
        for b in bases
    )
    out = []
    for n in names:
        b = n.removesuffix("Ranked")
        if n in _IN_MILLIONTHS:
            out.append(f"{q6(f'{b} / {MILLION}')} AS {n}")
        elif n == b:
            out.append(b)
        elif MEASURES[b].ranked == "by_values":
            out.append(
                f"CASE WHEN max({b}) OVER (PARTITION BY election_id) <= {MILLION} "
                f"THEN {_mean_rank(b, 'DESC')} ELSE {_mean_rank(b, 'ASC')} END AS {n}"
            )
        else:
            out.append(f"{_mean_rank(b, 'DESC' if MEASURES[b].ranked == 'desc' else 'ASC')} AS {n}")
    return (
        "WITH " + LINE_VOTES + VOTER_RANKS
        + f",\nmeasured AS (SELECT election_id, feature,\n         {folds}\n  FROM voter_ranks GROUP BY 1, 2)"
        + "\nSELECT feature, " + ",\n       ".join(out) + " FROM measured"
    )


# ---- folding of raw results ------------------------------------------------

RAW_RESULTS = f"""
lines AS (
  SELECT 1 + l_partkey % 2 AS experiment_id, 'm_' || l_returnflag AS method, l_linenumber - 1 AS outer_fold,
         CAST(l_suppkey % 3 AS INTEGER) AS inner_fold, {feature('l_partkey')} AS feature,
         CAST(l_quantity AS BIGINT) - 25 AS quantity, {pct('l_discount')} - 5 AS discount,
         {pct('l_tax')} - 4 AS tax
  FROM lineitem),
importances AS (
  SELECT experiment_id, method, outer_fold, inner_fold, feature, 'macro' AS kind, CAST(sum(quantity) AS DOUBLE) / 64 AS value
  FROM lines GROUP BY 1, 2, 3, 4, 5
  UNION ALL
  SELECT experiment_id, method, outer_fold, inner_fold, feature, 'shap', CAST(sum(tax) AS DOUBLE) / 64
  FROM lines WHERE method <> 'm_R' GROUP BY 1, 2, 3, 4, 5
  UNION ALL
  SELECT experiment_id, method, outer_fold, NULL, feature, 'micro', CAST(sum(discount) AS DOUBLE) / 64
  FROM lines GROUP BY 1, 2, 3, 5),
raw_reverse AS (
  SELECT 1 + l_partkey % 2 AS experiment_id, 'Reverse_' || l_linestatus AS method, l_linenumber - 1 AS outer_fold,
         {feature('l_partkey')} AS feature,
         CAST(sum({pct('l_discount')}) AS DOUBLE) / 1024 AS unlabeled,
         CAST(sum({pct('l_tax')}) AS DOUBLE) / 1024 AS labeled
  FROM lineitem GROUP BY 1, 2, 3, 4),
macro AS (SELECT method, outer_fold, feature, sum(abs(value)) AS score
          FROM importances WHERE kind = 'macro' GROUP BY 1, 2, 3),
micro AS (SELECT method, outer_fold, feature, value AS score FROM importances WHERE kind = 'micro'),
shap AS (SELECT method, outer_fold, feature, sum(abs(value)) AS score
         FROM importances WHERE kind = 'shap' AND (method, outer_fold) IN
           (SELECT method, outer_fold FROM importances WHERE kind = 'shap' AND inner_fold = 0)
         GROUP BY 1, 2, 3),
reverse AS (SELECT method, outer_fold, feature, greatest(labeled - unlabeled, 0) AS score FROM raw_reverse)"""

_ROWS = "method, outer_fold, feature"

FOLD_SCORES = RAW_RESULTS + """,
stacked AS (
  SELECT method || ' cumulated_macro_importance' AS method, outer_fold, feature, score FROM macro
  UNION ALL SELECT method || ' cumulated_micro_importance', outer_fold, feature, score FROM micro
  UNION ALL SELECT method || ' cumulated_shap_values', outer_fold, feature, score FROM shap
  UNION ALL SELECT method, outer_fold, feature, score FROM reverse),
fold_scores AS (
  SELECT method, outer_fold, feature,
         CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END AS score
  FROM (SELECT *, min(score) OVER (PARTITION BY method, outer_fold) AS lo,
                  max(score) OVER (PARTITION BY method, outer_fold) AS hi FROM stacked))"""


def _dense_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.line_fold_scores(spark, sf_dir).select("method", "outer_fold", "feature", "score")


def queries() -> dict:
    found = {key: aggregator_query(name) for key, name in AGGREGATOR_KEYS.items()}
    found |= {
        "ensemble_aggregate": ensemble_aggregate,
        "cumulated_macro": lambda s, d: _score(S.cumulated_macro(inputs.importances(s, d))),
        "micro_scores": lambda s, d: _score(S.micro_scores(inputs.importances(s, d))),
        "cumulated_shap": lambda s, d: _score(S.cumulated_shap(inputs.importances(s, d))),
        "reverse_weight": lambda s, d: _score(S.reverse_weight(inputs.raw_reverse(s, d))),
        "minmax_scores": lambda s, d: _score(_dense_scores(s, d)),
        "fold_scores": lambda s, d: _score(
            S.fold_scores(inputs.importances(s, d), inputs.raw_reverse(s, d))
        ),
        "cv_aggregate": lambda s, d: _score(cv_aggregate(_dense_scores(s, d))),
        "selected_subsets": lambda s, d: S.selected_subsets(_dense_scores(s, d)),
        "robust_features": lambda s, d: S.robust_features(_dense_scores(s, d), len(inputs.LINE_FOLDS)),
    }
    return found


def oracle_sql() -> dict[str, str]:
    found = {key: aggregator_sql(name) for key, name in AGGREGATOR_KEYS.items()}
    for key in ("macro", "micro", "shap", "reverse"):
        name = {"macro": "cumulated_macro", "micro": "micro_scores", "shap": "cumulated_shap", "reverse": "reverse_weight"}[key]
        found[name] = f"WITH {RAW_RESULTS}\nSELECT {_ROWS}, {q6('score')} AS score FROM {key}"
    found |= {
        "ensemble_aggregate": _ensemble_sql(),
        "minmax_scores": f"WITH {LINE_SCORES}\nSELECT {_ROWS}, {q6('score')} AS score FROM line_scores",
        "fold_scores": f"WITH {FOLD_SCORES}\nSELECT {_ROWS}, {q6('score')} AS score FROM fold_scores",
        "cv_aggregate": f"WITH {CV_SCORES}\nSELECT method, feature, {q6('score')} AS score FROM cv_scores",
        "selected_subsets": f"WITH {LINE_SCORES}\nSELECT {_ROWS} FROM line_scores WHERE score > 0",
        "robust_features": f"WITH {LINE_SCORES}\nSELECT method, feature, feature LIKE '%bm%' AS is_marker"
        " FROM line_scores WHERE score > 0 GROUP BY method, feature HAVING count(DISTINCT outer_fold) = 7",
    }
    return found
