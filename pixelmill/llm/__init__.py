"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage. Functions shipped to
executors are pickled by value, so a cluster needs no copy of the package on
its workers' import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
