"""Operators of a training-data pipeline: sharding, tokens, duplicates, classifiers, extraction, quality rules.

Functions that run in Python workers travel by value, so that executors need none of this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
