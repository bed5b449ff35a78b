"""Arrow batches of rows that a model scores: numbers in, one more column out.
Other columns pass as they are, so texts are never made into Python objects."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """(rows, columns) as doubles; nulls are NaN."""
    out = np.empty((batch.num_rows, len(names)))
    for i, n in enumerate(names):
        out[:, i] = batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False)
    return out


def with_values(batch: pa.RecordBatch, name: str, values: np.ndarray,
                drop: tuple[str, ...] = ()) -> pa.RecordBatch:
    """The batch without ``drop`` and with ``values``.  NaN becomes null, in
    every column of doubles."""
    keep = [(f.name, c) for f, c in zip(batch.schema, batch.columns) if f.name not in drop]
    cols = [pa.array(c.to_numpy(zero_copy_only=False), c.type, from_pandas=True)
            if pa.types.is_floating(c.type) else c for _, c in keep]
    return pa.RecordBatch.from_arrays([*cols, pa.array(values, pa.float64(), from_pandas=True)],
                                      names=[*(n for n, _ in keep), name])
