"""headway: transit schedules to connections, and feed data cleaning, on Spark.

Every public function takes and returns DataFrames and stays lazy; nothing is
collected unless its docstring says so and names the bound.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run in Python workers are shipped whole, so workers need no copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
