"""Operators for large text corpora. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Python workers need not find the package on their own path.
cloudpickle.register_pickle_by_value(sys.modules["phylomart"])
