"""helixframe: spectrum analytics and spectrum-based read correction as DataFrame plans."""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

# Functions of this package travel to executors by value, so a cluster needs
# no installation of the package beside Spark, numpy and pyarrow.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
