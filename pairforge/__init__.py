"""pairforge: a PySpark-native engine for preparing, balancing, searching and evaluating text-pair corpora."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run on executors travel with the job, so that no worker needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
