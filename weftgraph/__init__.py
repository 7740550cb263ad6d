"""weftgraph: code- and knowledge-graph analytics as Spark plans.

Everything is a DataFrame in, DataFrame out function over two core tables,
``nodes`` and ``edges`` (see :mod:`weftgraph.schema`).  Python workers are used
only where a parser or an inherently sequential algorithm demands it.
"""

import sys

from pyspark import cloudpickle

# Executors may not have this package on their path: ship its functions whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
