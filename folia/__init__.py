"""folia: document-intelligence and retrieval operators over Spark tables."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the executors by value, so a cluster needs no
# installed copy and no --py-files.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
