"""Operators for corpora of training text."""

import sys

from pyspark import cloudpickle

# tasks carry these functions with them, so that executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
