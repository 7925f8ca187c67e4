"""Training-data operators: thirteen corpus operators, their queries and the corpus pipeline's parts.

Nothing outside this subpackage imports it.  Functions that run on executors are
pickled by value, so executors need not have this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
