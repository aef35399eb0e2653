"""quarry: a Spark-native engine for corpus research over posts and threaded comments."""

import sys

from pyspark import cloudpickle

# Functions of this package travel with the task, so executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
