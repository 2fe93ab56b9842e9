"""Leafledger: profile, select, order, cut and render file and document corpora on Spark.

A *corpus* is any DataFrame with ``relpath``, ``size_bytes`` and ``text`` (or
binary ``content``); ``mtime`` is optional.  Every operator takes and returns
DataFrames or Columns and leaves the physical plan to Catalyst.
"""

import sys

from pyspark import cloudpickle

# Python workers get the few small helpers with the job, so the package need
# not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
