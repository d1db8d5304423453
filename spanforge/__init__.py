"""Evidence-grounded text abstraction and corpus preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

#: Executors need no installed copy of this package: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
