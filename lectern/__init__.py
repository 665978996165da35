"""Documents to cited passages, lexical search and training-data operators on Spark."""

import sys

import pyspark.cloudpickle as cloudpickle

# Python workers get the functions themselves: they need not find this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
