"""Point-in-time equity factor analytics on PySpark."""

import sys

from pyspark import cloudpickle

# what runs on executors is sent there by value, so nodes need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
