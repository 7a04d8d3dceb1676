"""Operators for preparing training data; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# tasks get this code with the job, so executors need no copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])
