"""Queries over the driver's tables; importing this package registers them all."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

from panelloom.plans import clusters, contracts, evaluation, graphs, ingest, moves, partitions, queries, scoring, statistics  # noqa: E402, F401
