"""Operators of a training-data pipeline. Nothing else in the library imports this folder.

Functions defined here travel to the executors by value, so a cluster needs no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
