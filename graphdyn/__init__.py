"""Signals-on-graphs analytics expressed as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so executors need
# nothing but PySpark, numpy and pandas.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
