"""A Spark-first analytics engine for versioned, release-based public data sets."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package go to Python workers as they are, so that workers need not find the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
