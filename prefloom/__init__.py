"""Preference-data analytics on Spark.

Functions that run in Python workers are pickled by value, so executors need no copy of this package.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
