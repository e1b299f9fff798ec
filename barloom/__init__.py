"""barloom: market-data analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel by value, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
