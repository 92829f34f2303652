"""A Spark-native engine for selection-round sequencing reads.

Functions that run in Python workers are pickled by value, so that executors need no copy of
this package.
"""

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(__import__(__name__))
