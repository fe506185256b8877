"""Groups of rows in a sorted stream of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def gathered(batches, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in batches of about `size` bytes; a larger one stays as it is."""
    kept: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        if kept and held + batch.nbytes > size:
            yield pa.concat_batches(kept)
            kept, held = [], 0
        kept.append(batch)
        held += batch.nbytes
    if kept:
        yield pa.concat_batches(kept)


def groups(batches, key: int) -> Iterator[pa.Table]:
    """Tables of the rows that agree in the first `key` integer columns; the input is sorted by them."""
    kept: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy() for i in range(key)]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1 if batch.num_rows > 1 else np.zeros(0, np.int64)
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            now = tuple(int(c[lo]) for c in cols)
            if kept and now != last:
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(batch.slice(lo, hi - lo))
            last = now
    if kept:
        yield pa.Table.from_batches(kept)
