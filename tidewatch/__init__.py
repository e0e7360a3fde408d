"""Tidewatch: news-risk analytics on PySpark DataFrames and Structured Streaming."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# tasks get the package's functions by value, so executors need no installation of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
