"""Operators for building training corpora.

Nothing else in ``graphmill`` imports this subpackage.  Functions that run on
executors are pickled by value, so a cluster needs only the libraries they
use, not a copy of this package.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
