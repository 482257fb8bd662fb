"""Training-data pipeline operators. Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Functions for executors travel with their code, so a worker needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
