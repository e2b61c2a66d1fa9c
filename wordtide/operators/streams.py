"""Sorted rows of a task as whole groups."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def whole_groups(batches, keys, shrink=None):
    """Tables of complete groups and the ends of the groups in them, from batches sorted by keys.

    Only the last group of a batch is carried on. `shrink`, if given, is applied to a table whose
    last group goes on, so that a group of any size stays small.
    """
    import pyarrow as pa

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        ends = group_ends(held, keys)
        cut = int(ends[-2]) if len(ends) > 1 else 0
        if cut:
            yield held.slice(0, cut).combine_chunks(), ends[:-1]
        held = held.slice(cut)
        if shrink is not None:
            held = shrink(held)
    if held is not None and held.num_rows:
        yield held.combine_chunks(), group_ends(held, keys)


def group_ends(table, keys):
    import numpy as np

    change = np.zeros(max(table.num_rows - 1, 0), dtype=bool)
    for key in keys:
        values = table.column(key).to_numpy()
        change |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(change) + 1, table.num_rows)
