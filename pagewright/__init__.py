"""pagewright: document fingerprinting, clustering and page analytics on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to Python workers travel by value: a cluster need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
