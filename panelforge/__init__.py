"""Cross-sectional time-series analytics expressed as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors need not have the package installed: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
