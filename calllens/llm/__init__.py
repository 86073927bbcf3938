"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Its functions travel to the
executors by value, so a job needs no copy of the package on their import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
