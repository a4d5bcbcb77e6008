"""leafmill: document-corpus analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Arrow UDFs carry their helpers along, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
