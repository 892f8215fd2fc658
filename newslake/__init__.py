"""newslake: article watch and retrieval as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Arrow functions travel to the executors by value, so no worker needs this package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
