"""Protein-map analytics as Spark jobs.

``sources``    readers and writers for hit tables, structures, matrices and lists
``functions``  column expressions (no shuffles)
``operators``  DataFrame-to-DataFrame transformations
``plans``      the two end-to-end runs (search and cluster mode) and their settings
``streaming``  resumable, incremental ingestion of hit files
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to Python workers travel by value, so a job needs no copy of this
# package on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
