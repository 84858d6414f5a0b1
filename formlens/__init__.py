"""Prompt-format sensitivity studies as Spark jobs over tables."""

import sys

from pyspark import cloudpickle

# Executors get the functions of this package with the task, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
