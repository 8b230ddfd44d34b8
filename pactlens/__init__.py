"""pactlens: contract-risk review as PySpark DataFrame and Structured Streaming jobs."""

import sys

from pyspark import cloudpickle

from pactlens.session import build_session

# Functions of this package travel to the Python workers by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]
