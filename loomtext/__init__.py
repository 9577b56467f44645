"""loomtext: text matching, profiling and corpus preparation as PySpark DataFrame pipelines."""

import sys

from pyspark import cloudpickle

# Functions go to the executors by value, so the package has to be installed on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
