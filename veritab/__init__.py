"""Judging, repairing and generating synthetic tables on Spark."""

import sys

from pyspark import cloudpickle

# Python helpers travel to the executors with the job, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
