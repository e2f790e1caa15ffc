"""Comparing rows inside cells - blocks of buckets, or two blocks against each other - many cells at a time.

Cells come as sorted Arrow batches whose first columns name the cell.
"""

from __future__ import annotations

from itertools import chain

from .common import give_back

#: Rows that are compared at a time, and whole cells beyond that.
ROWS = 4096


def whole_cells(batches, width: int):
    """(table, end of each row's cell) with whole cells only; the first ``width`` columns name the cell."""
    import numpy as np
    import pyarrow as pa

    held = None
    for batch in chain(batches, [None]):
        if batch is not None:
            fresh = pa.Table.from_batches([batch])
            held = fresh if held is None else pa.concat_tables([held, fresh])
            if held.num_rows < ROWS:
                continue
        if held is None or not held.num_rows:
            continue
        held = held.combine_chunks()
        cell = np.stack([held.column(k).to_numpy().astype(np.int64) for k in range(width)], 1)
        begins = np.concatenate([[0], np.flatnonzero((cell[1:] != cell[:-1]).any(1)) + 1])
        last = 0
        while last < len(begins):  # as many cells as fill ROWS, one at least
            stop = max(last + 1, int(np.searchsorted(begins, begins[last] + ROWS, "right")) - 1)
            if stop >= len(begins):
                if batch is not None:
                    break
                stop = len(begins)
            low, high = begins[last], begins[stop] if stop < len(begins) else held.num_rows
            sizes = np.diff(np.append(begins[last:stop], high))
            yield held.slice(low, high - low), np.repeat(np.cumsum(sizes), sizes)
            last = stop
        held = held.slice(begins[last]) if last < len(begins) else None
    give_back()


def pairs_in(ends, test):
    """Index pairs of rows of one cell that pass ``test(a, b)``, which gives the places of those that do.

    Goes by the distance of the rows: all rows with their next, next but one, and so on."""
    import numpy as np

    a, left, right = np.arange(len(ends)), [], []
    for k in range(1, len(ends)):
        a = a[a + k < ends[a]]
        if not len(a):
            break
        some = a[test(a, a + k)]
        if len(some):
            left.append(some)
            right.append(some + k)
    return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))


def binary(rows):
    """An Arrow column of binary values out of an array of numbers, a row each."""
    import numpy as np
    import pyarrow as pa

    raw = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    size = raw.shape[1]
    return pa.BinaryArray.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(np.arange(0, (len(raw) + 1) * size, size, dtype=np.int32)), pa.py_buffer(raw)])


def matrix(column, kind):
    """The rows of a binary Arrow column of one size as an array."""
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)
