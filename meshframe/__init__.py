"""Iterative graph, grid, matrix, clustering and image kernels as DataFrame pipelines.

Python functions that run on executors are pickled by value, so a cluster needs no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
