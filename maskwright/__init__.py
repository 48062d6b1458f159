"""Mask analytics as Spark jobs: run-length masks, matching, policies, scores, data sets."""

import sys

from pyspark import cloudpickle

# Functions used inside tasks travel by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
