"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Python functions that run on executors are pickled by
value, so a cluster needs no copy of this package on its nodes.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
