"""Training-data operators: near duplicates, fingerprints, scans, mixing, sharding, chat.

Nothing else in the package imports this subpackage.  Each module holds one
operator; ``queries`` binds them to the test tables.

Functions that run in tasks are shipped by value, so executors need numpy and
pyarrow but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
