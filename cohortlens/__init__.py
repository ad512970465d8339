"""Cohort-outcome analytics as Spark jobs.

``functions`` holds column expressions, ``sources`` readers and writers, ``operators``
DataFrame-to-DataFrame steps, and ``plans`` the jobs composed from them.
"""

import sys

from pyspark import cloudpickle

# The few Python helpers travel with the tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
