"""Document analytics on PySpark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so a job needs no
# installed copy there and no path settings.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
