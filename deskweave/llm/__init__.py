"""Operators for large text corpora. Nothing else in the library imports this subpackage."""

from pyspark import cloudpickle

import deskweave

# Python tasks get these functions by value, so executors need no copy of the repository.
cloudpickle.register_pickle_by_value(deskweave)
