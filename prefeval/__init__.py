"""prefeval: Spark-native preference data and judge evaluation."""

import sys as _sys

try:
    # Python stages (model calls, EMA folds, stateful streams) are shipped to
    # executors by value, so workers do not need this package installed.
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle without the hook
    pass
