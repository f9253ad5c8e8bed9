"""Event signals on ordered OHLC bars, as composable Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# functions of this package that run in Python workers travel with the job: nothing to install there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
