"""Schemas of the tables the operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T

_D, _I, _L, _S = T.DoubleType(), T.IntegerType(), T.LongType(), T.StringType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in columns.items()])


CELLS = _schema(sample_id=_L, label=_I, feature=_S, feature_ord=_I, value=_D)
FEATURES = _schema(feature=_S, feature_ord=_I)
IMPORTANCES = _schema(
    experiment_id=_L, method=_S, outer_fold=_I, inner_fold=_I, kind=_S, feature=_S, value=_D
)
RAW_STANDARD = _schema(
    experiment_id=_L,
    method=_S,
    outer_fold=_I,
    validation_metric=_D,
    best_params=T.MapType(_S, _D),
)
RAW_REVERSE = _schema(
    experiment_id=_L, method=_S, outer_fold=_I, feature=_S, unlabeled=_D, labeled=_D
)
FOLD_SCORES = _schema(method=_S, outer_fold=_I, feature=_S, score=_D)
VOTES = _schema(election_id=_S, feature=_S, method=_S, score=_D)
BALLOTS = _schema(election_id=_S, method=_S, feature=_S, feature_ord=_L, rk=_L)
METHOD_WEIGHTS = _schema(method=_S, acc=_D)
POWER_SAMPLES = _schema(
    ts=T.TimestampType(),
    node_id=_S,
    workflow_element=_S,
    total_w=_D,
    cpu_w=_D,
    peg_w=_D,
    ok=T.BooleanType(),
)
EXPERIMENTS = _schema(experiment_id=_L, created=T.TimestampType(), settings=T.MapType(_S, _S))
BENCHMARKS = _schema(experiment_id=_L, element=_S, seconds=_D, node_id=_S, joules=_D)

# names of the three importance kinds in the score table
KIND_LABELS = {
    "macro": "cumulated_macro_importance",
    "micro": "cumulated_micro_importance",
    "shap": "cumulated_shap_values",
}
