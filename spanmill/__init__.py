"""spanmill: text segmentation, span algebra and corpus preparation on PySpark.

Functions that run inside Python workers are pickled by value, so executors
need PySpark, Arrow and numpy but no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
