"""framesift: scene-memory analytics on Spark.

Functions that run on executors are pickled by value, so a worker needs
nothing but the Python environment of the driver.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
