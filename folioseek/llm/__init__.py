"""Operators for preparing training text: dedup, filters, search, mixing, sharding, packing.

Nothing else in the library imports this package.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
