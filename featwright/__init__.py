"""featwright: feature selection and rank aggregation as Spark DataFrame operators.

Tables are long: one row per (sample, feature) cell or per (feature, method,
fold) vote, so features, methods, folds and trials are data that Spark
partitions, not loops in Python.
"""

import sys

from pyspark import cloudpickle

from featwright.settings import Settings

# Functions sent to Python workers carry their code along, so that executors
# need numpy and pandas but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Settings"]
