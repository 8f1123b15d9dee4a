"""Tabular machine-learning preparation, training and evaluation on Spark."""

import sys

from pyspark import cloudpickle

# Functions run inside tasks travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
