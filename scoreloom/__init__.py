"""scoreloom: corpus building, response scoring and rollout analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# User functions carry this package with them, so executors need no separate installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
