"""chorus: analytics over multi-model answer logs, written as Spark DataFrame jobs.

The central table is the ensemble log: one row per question asked of several models, with the
models' answers nested in ``responses`` (array of structs, in rank order) and the judge's
consensus, confidence and final answer alongside. Every operator takes and returns DataFrames;
"""

import sys as _sys

try:
    # Functions that run in Python workers (mapInPandas / applyInPandas bodies, model-call
    # functions) are shipped by value with the task, so executors need no copy of this package.
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older pyspark without the vendored cloudpickle API
    pass

__all__ = ["session"]
