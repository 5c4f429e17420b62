"""Spark-native change-impact analytics: facts are tables, every analysis step is a DataFrame plan."""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# functions that run in Python workers travel with the task: executors need no copy of this package
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
