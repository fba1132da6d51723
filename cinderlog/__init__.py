"""Incident log analytics and evidence-grounded retrieval on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from cinderlog.session import configure

# The few Python functions that run inside tasks travel with the query, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["configure"]
