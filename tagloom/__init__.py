"""Tag-read cleansing, deduplication and delivery preparation on Spark."""

import sys

from pyspark import cloudpickle

# Python tasks carry the functions they call, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
