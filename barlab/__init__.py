"""Event studies on time-series bars, written as PySpark DataFrame jobs."""
import sys

from pyspark import cloudpickle

# the few functions that run inside tasks travel with their closure, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
