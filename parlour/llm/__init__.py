"""Operators of a training-data pipeline (dedup, filters, scans, classifiers, packing).

Nothing outside this package imports it. Its functions travel to the executors by value, so that a job
needs no copy of the package there."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
