"""quillspark: build, query and evaluate corpora of structured documents on Spark.

Functions that run in Python workers are pickled by value, so executors need the
public libraries only and not this package on their import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
