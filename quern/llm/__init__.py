"""Operators for preparing training data: one module each, with a general interface of their own.

What runs in Python workers is shipped by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
