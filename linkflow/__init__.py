
import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run on executors travel by value, so a session started anywhere can use the
# library without its folder being on the workers' path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
