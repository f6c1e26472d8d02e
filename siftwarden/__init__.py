"""Text and agent-traffic inspection as PySpark jobs over tables and streams."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to executors by value: nothing to install there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
