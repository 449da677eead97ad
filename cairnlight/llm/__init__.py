"""Training-data operators. Nothing outside this subpackage imports it.

Their Python functions travel to the workers by value, so that executors need
no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
