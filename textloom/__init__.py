"""A PySpark engine for qualitative text corpora and training data.

Functions that run in Python workers are pickled by value, so executors need no copy of the code.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
