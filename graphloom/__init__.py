"""graphloom: Spark-native analytics for code-repository and corpus tables."""

from pyspark import cloudpickle as _cloudpickle

import graphloom as _self

# Functions that run in Python workers travel with their code, so executors
# need no copy of this package on their import path.
_cloudpickle.register_pickle_by_value(_self)
