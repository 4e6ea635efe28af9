"""Operators for preparing training text; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Code for tasks travels with them, so executors need Spark, numpy, pyarrow and zstandard only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
