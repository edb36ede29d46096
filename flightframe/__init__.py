"""Aerial-video analytics on Spark: boxes, sequences, navigation, matching and evaluation."""

import sys

from pyspark import cloudpickle

# Small Python helpers travel to the executors with the job, so the package need not be there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
