"""Spark-first analytics engine for text and code corpora.

Functions that run inside Python workers are pickled by value, so executors do
not need this package on their import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
