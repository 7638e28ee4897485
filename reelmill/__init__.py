"""Recommendation, search and retrieval analytics as set-oriented Spark jobs."""

import sys

from pyspark import cloudpickle

# Block functions travel to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
