"""tessera: block linear algebra, task-graph analytics and training-data operators on Spark DataFrames.

Functions of this package travel to the executors by value, so those need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
