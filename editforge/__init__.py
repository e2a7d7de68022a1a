"""editforge: a Spark-native engine that prepares source-code corpora for training.

Every operator is a plain ``DataFrame -> DataFrame`` function built on Spark's
SQL primitives (joins, windows, aggregates, higher-order functions); the few
Python steps work on Arrow batches. Functions travel to the executors by
value, so workers need no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.2.0"
