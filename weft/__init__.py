"""Portfolio-overlap analytics as Spark plans."""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: what runs in their Python workers is sent with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
