"""Document search on Spark: typed ingest, positional postings, batch retrieval."""

import sys

from pyspark import cloudpickle

from .spec import Field, IndexSpec

__all__ = ["Field", "IndexSpec"]

# Functions that run in Python workers travel with their code: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
