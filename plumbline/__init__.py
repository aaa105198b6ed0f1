"""plumbline: leak-safe feature, evaluation and corpus operators for Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Helpers used inside tasks travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
