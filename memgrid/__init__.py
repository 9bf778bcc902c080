"""Spark-native retrieval, graph and text analytics over DataFrames."""

import sys

from pyspark import cloudpickle

# Executors then need no copy of this package: functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
