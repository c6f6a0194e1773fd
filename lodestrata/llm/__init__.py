"""Corpus-preparation operators for training data.

Nothing else in the library imports this subpackage.  ``entry`` holds the
registered queries and their SQL.
"""
import sys

from pyspark import cloudpickle

# Functions sent to executors carry their own code, so workers need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
