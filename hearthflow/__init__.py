"""Hearthflow: sensor-telemetry analytics written as ordinary PySpark jobs."""

import sys

from pyspark import cloudpickle

# The step functions travel to the executors with the job, so nothing needs installing there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
