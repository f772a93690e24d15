"""Operators for training-data pipelines. Nothing else in the library imports them.

Functions that run in Python workers travel by value, so executors need the
public libraries only, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
