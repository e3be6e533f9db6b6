"""tarifflow: price-page snapshots, changes and plans as Spark jobs."""

import sys

from pyspark import cloudpickle

# The few Python helpers that run on executors travel inside the tasks, so the
# package needs no installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
