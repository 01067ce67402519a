"""profilewright: mutation-profile analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors by value, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
