"""Speech-quality analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# batch functions travel to the executors with their code, so nothing has to be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
