"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  Functions that run on executors
are pickled by value, so a cluster needs no copy of the package on its nodes.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
