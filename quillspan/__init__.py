"""quillspan: a Spark-native engine for text, character spans and training corpora."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel by value, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
