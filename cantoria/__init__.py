"""cantoria — Spark-native text-corpus analytics.

documents -> units (verse / stanza) -> scores -> document rollup -> threshold -> time series,
expressed as composable ``DataFrame -> DataFrame`` operators on Spark SQL.
"""

import sys as _sys

from cantoria.fixed import DIMS, INTENSITY_COLS, LABEL_COLS

# Python steps (Arrow UDF, applyInPandas, mapInPandas) are shipped to executors by value, so workers need no
# installed copy of this package and no path setup.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

__all__ = ["DIMS", "INTENSITY_COLS", "LABEL_COLS"]
