"""millrace: a PySpark engine for very high-dimensional sparse data."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers are sent by value, so executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
