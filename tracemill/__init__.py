"""Spark-native analytics over coding-agent session logs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so no executor needs it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
