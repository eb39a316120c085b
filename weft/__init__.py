"""weft: profile alignment and corpus analytics expressed on Spark DataFrames."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Python functions that run on executors are shipped with their code, so that
# a cluster needs no installed copy of this package.
register_pickle_by_value(sys.modules[__name__])
