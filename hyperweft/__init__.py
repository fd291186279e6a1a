"""Hypergraph summarization and analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors with their code, so that a job needs no installed copy of this package there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
