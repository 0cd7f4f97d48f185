"""Graph analytics over Spark tables."""
import sys

from pyspark import cloudpickle

# what runs on executors travels with its code, so a cluster needs no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
