"""docmill: document preparation and quality gates as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to executors by value, so executors
# need no copy of the package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
