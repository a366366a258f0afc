"""Operators for preparing training text at scale; nothing else in the library imports this.

Task code travels with the job, so the package need not be installed on executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
