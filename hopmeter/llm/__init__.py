"""Operators of a training-data pipeline over documents and pages.

Functions that run in tasks are sent with their code, so executors need no copy
of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
