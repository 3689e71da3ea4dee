"""Tidemark: timed-evidence analytics on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their own code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
