"""Operators a training-data pipeline needs: one module per operator, queries in ``queries``.

Nothing outside this folder imports it.
"""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
