"""Operators of a training-data pipeline, each by one named method.

Nothing else in the package imports this one. Functions that run inside Python
workers are pickled by value, so workers need only the public libraries.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
