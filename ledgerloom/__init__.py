"""Spark-native market-desk and commerce analytics."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the job, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
