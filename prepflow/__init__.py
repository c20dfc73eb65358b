"""Profiling, cleaning, feature engineering and baseline modelling of tables too large for one machine."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel by value, so executors need not have
# this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
