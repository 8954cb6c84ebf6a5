"""factaudit: a PySpark-native engine for auditing factual question-answer datasets."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value: a cluster's executors need not have
# this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
