"""Report-mining analytics on Spark: plain ``DataFrame -> DataFrame`` functions that Catalyst plans."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
