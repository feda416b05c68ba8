"""Spark-native curation, exemplar retrieval and evaluation statistics.

The public API is functions from DataFrame to DataFrame, grouped as

* ``assaykit.sources``    readers, writers and path parsing
* ``assaykit.functions``  Column expressions (labels, text, pixels, keyed draws)
* ``assaykit.operators``  sampling, splits, retrieval, metrics, resampling, reports
* ``assaykit.plans``      whole jobs composed of the operators
* ``assaykit.streaming``  incremental scoring
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to Python workers travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
