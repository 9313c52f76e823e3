"""Millrace: code-knowledge analytics and training-data operations on Spark DataFrames.

Functions of this package travel to executors by value, so a cluster needs no installation of it there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
