"""Operations of a training-data pipeline; optional, and used by no other part of the library.

Functions that run on executors are sent there whole, so that executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
