"""Arrow batches in slices of bounded size: what Python makes of a text may take many times its bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(texts: pa.Array, limit: int) -> Iterator[pa.Array]:
    """The array in slices of at most limit bytes of text, or one text if that alone is longer."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield texts.slice(start, end - start)
        start = end
