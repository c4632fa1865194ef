"""Search, ranking and search-log analytics over story collections, planned by Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their own code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
