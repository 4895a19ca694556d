"""Parcelight: Spark-native analytics for building-level solar prospecting data."""

import sys

from pyspark import cloudpickle

# Workers get the functions themselves, so the package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
