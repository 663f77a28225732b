"""What the vector operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def as_arrays(column: pa.Array) -> Iterator[np.ndarray | None]:
    """Each list as doubles; None where the list is null or holds a null or a non-finite component."""
    for v in column:
        values = v.values if v.is_valid else None
        if values is None or values.null_count:
            yield None
            continue
        x = values.to_numpy(zero_copy_only=False).astype(float)
        yield x if np.isfinite(x).all() else None
