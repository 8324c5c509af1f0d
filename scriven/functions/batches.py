"""Arrow batches worked on a piece at a time: a worker holds little besides the batch and its result."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a piece, which is one row at least.
PIECE = 1 << 20


def mapped(fn: Callable, kind: pa.DataType, texts: pa.Array, *others: pa.Array) -> pa.Array:
    """``fn`` of each row, null where the text is null; memory that is free then goes back to the system."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    parts, a = [pa.array([], kind)], 0
    while a < len(texts):
        z = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + PIECE, side="right")))
        rows = zip(*(x.slice(a, z - a).to_pylist() for x in (texts, *others)))
        parts.append(pa.array([None if t is None else fn(t, *rest) for t, *rest in rows], kind))
        a = z
    out = pa.concat_arrays(parts)
    del parts
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
    return out
