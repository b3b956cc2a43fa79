"""kvatlas: key-value configuration analytics and retrieval on Spark."""

import sys

from pyspark import cloudpickle

# functions that run inside tasks are shipped with the plan, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
