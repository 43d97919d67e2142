"""Spark-native document analytics, evidence retrieval and training-data operators."""

import sys

from pyspark import cloudpickle

# Executors get the functions themselves, not a reference to a package that they may not have.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
