"""veilspan: span analytics for personal data, and corpus preparation, on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value, so an executor
# needs no copy of the package on its own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
