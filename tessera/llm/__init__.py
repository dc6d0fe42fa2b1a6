"""Operators for large training-data pipelines. Nothing outside this folder imports it.

Functions of this package travel to the executors by value, so those need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
