"""A data-mining and analytics engine on Spark's DataFrame, SQL and Structured Streaming interfaces.

Functions sent to executors are pickled by value, so executors need not have the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
