"""runlens: evidence analytics for machine-learning runs, expressed as Spark plans.

The package's functions travel inside the tasks, so that executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
