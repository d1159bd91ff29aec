"""Operators of a training-data pipeline. Nothing outside this package imports it.

Functions run in tasks are shipped by value, so executors need only Python's public packages, not this one.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
