"""millrace: ingest, clean, check and analyse time-stamped records with Spark DataFrames."""

import sys

from pyspark import cloudpickle

from .session import build_session, materialize

# the few Python helpers that run inside tasks travel with the job, so executors need no install
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "materialize"]
