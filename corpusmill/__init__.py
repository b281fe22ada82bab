"""corpusmill: text-corpus preparation and analysis as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers with the job that calls them,
# so the package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
