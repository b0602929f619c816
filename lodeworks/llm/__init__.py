"""Operators that a training-data pipeline needs, each a DataFrame-in, DataFrame-out function.

Nothing else in the library imports this package. Functions sent to executors are pickled by value,
so executors need not have the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
