"""Sources, sinks and tables in the shared folder; functions of workers are shipped by value."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
