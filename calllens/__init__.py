"""Sales-call analytics as Spark DataFrame operators.

Functions that run in Python workers travel to them by value, so a job needs no copy of
the package on the executors.
"""

import sys

from pyspark import cloudpickle

from calllens.config import BOOTSTRAP, V30, V31, Profile, profile

__all__ = ["BOOTSTRAP", "V30", "V31", "Profile", "profile"]

cloudpickle.register_pickle_by_value(sys.modules[__name__])
