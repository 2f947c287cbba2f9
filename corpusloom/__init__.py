"""corpusloom: retrieval and corpus analytics over text tables, as Spark DataFrames.

``sources``    readers, validation, upserts and sinks
``functions``  column expressions (text, html, urls, dense vectors)
``operators``  DataFrame -> DataFrame operators
``streaming``  Structured Streaming jobs
``plans``      whole jobs composed from the operators, and the named query catalog
"""

import sys

from pyspark import cloudpickle

# The few Arrow kernels travel with the job, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
