"""Code-fact analytics on Spark: facts about files as tables, queries over them as DataFrames.

Functions that run in Python workers are pickled by value, so executors need
no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
