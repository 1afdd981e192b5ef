"""rareflow: rare-event (conversion style) table analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Tasks carry the code they run, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
