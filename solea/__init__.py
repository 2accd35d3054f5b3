"""Screening-cohort analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Python steps travel to the executors by value, so these need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
