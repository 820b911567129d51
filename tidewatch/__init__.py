"""Signal ranking, auditing and corpus preparation on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so a job works from
# whatever folder it is started in and executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
