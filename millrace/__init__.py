"""Data-quality and preparation operators for PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Helpers that run inside tasks travel with the task: workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
