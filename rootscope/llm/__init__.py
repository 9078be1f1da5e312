"""Operators for large-scale training-data preparation; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so that workers need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
