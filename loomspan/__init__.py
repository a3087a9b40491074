"""Spark-native engine that turns document collections into retrieval-ready chunks."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the Python workers by value: executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
