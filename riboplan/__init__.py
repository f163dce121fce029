"""Sequencing-style analytics as Spark plans.

Functions of this package travel to the executors with their code, so only the driver needs it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
