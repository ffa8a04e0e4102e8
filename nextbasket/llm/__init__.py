"""Operators for preparing language-model training data on Spark.

Nothing else in the package imports this subpackage. Functions that run in Python
workers are pickled by value, so executors need the third-party libraries only.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
