"""Arrow list columns as numpy matrices and back, for the functions run in tasks."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Executors get the functions by value and need no installed package. Task
# functions must therefore name other functions directly, not through a module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def matrix(table, column: str):
    """Arrow list column as a two-dimensional array."""
    import numpy as np

    values = table.column(column).combine_chunks()
    return np.asarray(values.flatten()).reshape(len(values), -1)


def lists(array):
    """Two-dimensional array as an Arrow list column."""
    import numpy as np
    import pyarrow as pa

    array = np.ascontiguousarray(array, dtype="float64")
    ends = np.arange(array.shape[0] + 1, dtype="int32") * array.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(array.ravel()))
