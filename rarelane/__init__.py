"""rarelane: Spark operators for classification of rare events in tables.

DataFrame in, DataFrame out.  The packages below follow the road a table takes:

``sources``     reading raw tables and saved runs, writing results and models
``functions``   column expressions (labels, row aggregates, hash draws)
``operators``   table operators (encode, sample, split, scale, neighbours, ...)
``estimators``  fitted models that score with column expressions
``plans``       whole preparations, experiments and grids of experiments
``catalog``     the registered queries and the SQL each one is checked with
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code with them, so the package need
# not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
