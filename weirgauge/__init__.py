"""Weirgauge: network-flow analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The few Python helpers travel inside the tasks, so executors need no copy of
# the package on their import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
