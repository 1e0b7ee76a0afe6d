"""fieldglass: exact, explainable aggregate fields over large flat tables, on Spark.

Every operator maps DataFrames to DataFrames (or builds Columns), so plans
stay lazy and Catalyst sees the whole query.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
