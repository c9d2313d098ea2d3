"""Tessella: dependency-graph and corpus analytics on Apache Spark.

The engine is a set of functions over DataFrames.  Code that runs in Python
workers is shipped by value, so executors do not need this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
