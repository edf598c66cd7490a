"""Arrow tables that hold whole groups of a sorted stream."""

from __future__ import annotations


def whole_groups(batches, key: str):
    """Tables of a stream sorted by ``key`` (an integer column), no key in two of them."""
    import numpy as np
    import pyarrow as pa

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        table = new if held is None else pa.concat_tables([held, new])
        values = table.column(key).to_numpy()
        last = int(np.searchsorted(values, values[-1]))
        if last:
            yield table.slice(0, last).combine_chunks()
        held = table.slice(last)
    if held is not None:
        yield held.combine_chunks()


def blocks_of(batches, key: str, size: int):
    """Tables of a stream sorted by ``key``: one key each and a multiple of ``size`` rows,
    but for the last of a key. Between batches fewer than ``size`` rows are held."""
    import numpy as np
    import pyarrow as pa

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        table = new if held is None else pa.concat_tables([held, new])
        values, n = table.column(key).to_numpy(), table.num_rows
        cuts = np.append(first_of(values), n).tolist()
        held = None
        for a, b in zip(cuts, cuts[1:]):
            end = b if b < n else b - (b - a) % size
            if end > a:
                yield table.slice(a, end - a).combine_chunks()
            if end < b:
                held = table.slice(end)
    if held is not None:
        yield held.combine_chunks()


def first_of(values):
    """Positions at which a sorted array takes a new value."""
    import numpy as np

    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.flatnonzero(new)


def rank_in_group(keys):
    """Position of each element inside its run of equal keys."""
    import numpy as np

    first = first_of(keys)
    return np.arange(len(keys)) - np.repeat(first, np.diff(np.append(first, len(keys))))


def as_lists(keys, *columns):
    """(one key per run, list arrays of each column) for columns sorted by key."""
    import numpy as np
    import pyarrow as pa

    first = first_of(keys)
    offsets = pa.array(np.append(first, len(keys)), pa.int32())
    return [pa.array(keys[first]), *(pa.ListArray.from_arrays(offsets, pa.array(c)) for c in columns)]
