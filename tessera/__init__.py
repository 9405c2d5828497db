"""Context-retrieval analytics on Spark: indexed repositories as relational snapshots, searched, ranked and measured with DataFrames."""

import sys

from pyspark import cloudpickle

# Tasks carry the functions of this package with them; executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
