"""Perceptual-hash analytics on Spark: scan, modify, hash, match, sweep, report.

Functions sent to Python workers are pickled by value, so an executor needs only the
third-party libraries, not a copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
