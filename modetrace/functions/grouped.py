"""Groups of rows that lie next to each other in a partition, many at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], starts: str) -> Iterator[pa.Table]:
    """Tables of whole groups from the batches of a partition in order; ``starts`` is true
    at the first row of each group. What is kept back is the last group, until it ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        begins = np.flatnonzero(batch.column(starts).to_numpy(zero_copy_only=False))
        if not len(begins):
            held.append(batch)
            continue
        last = int(begins[-1])
        ended = [b for b in (*held, batch.slice(0, last)) if b.num_rows]
        held = [batch.slice(last)]
        if ended:
            yield pa.Table.from_batches(ended).combine_chunks()
    if held := [b for b in held if b.num_rows]:
        yield pa.Table.from_batches(held).combine_chunks()
