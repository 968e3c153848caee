"""Operators of a training-data pipeline, as Spark jobs.

Code that runs inside Spark's Python workers is shipped by value, so the
executors need nothing of this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
