"""Backtesting analytics on Spark: bars and jobs in, results out."""

import sys

from pyspark import cloudpickle

# Executors receive the functions of this package with the tasks; nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
