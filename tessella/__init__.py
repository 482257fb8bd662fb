"""Spark-first analytics for a document knowledge base: ingest, sync, retrieval, memory, review and export."""

import sys

from pyspark import cloudpickle

# Functions for executors travel with their code, so a worker needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
