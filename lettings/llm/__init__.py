"""Operators for preparing training text; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel with their code, so executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
