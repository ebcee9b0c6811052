"""Inside a task: where two short paths come closest, as arrays over pairs of tracks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa

#: Pairs of points that are compared at once.
PAIRS = 1 << 18


def closest(columns: Sequence[pa.Array], limit: float) -> pa.Array:
    """For each pair the least (distance, frame of one, frame of the other) within the limit, null for none.

    columns: lists of x, y and frames of the one path, then of the other.
    """
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in columns]
    sizes = [np.diff(columns[k].offsets.to_numpy()) for k in (0, 3)]
    first = [np.cumsum(n) - n for n in sizes]
    least, frames = np.full(len(sizes[0]), np.nan), np.zeros((2, len(sizes[0])), dtype=np.int64)
    step = max(1, PAIRS // max(1, int(sizes[0].max(initial=0)) * int(sizes[1].max(initial=0))))
    for some in (slice(i, i + step) for i in range(0, len(least), step)):
        # shorter paths are filled up with what is near to nothing
        sides = []
        for k in (0, 1):
            n, place = sizes[k][some, None], np.arange(sizes[k][some].max())
            at = np.where(place < n, first[k][some, None] + place, 0)
            sides.append([*(np.where(place < n, flat[3 * k + c][at], np.nan) for c in (0, 1)), flat[3 * k + 2][at]])
        (ax, ay, fa), (bx, by, fb) = sides
        u, v = ax[:, :, None] - bx[:, None, :], ay[:, :, None] - by[:, None, :]
        d = np.sqrt(u * u + v * v)
        pair, i, j = np.nonzero(d <= limit)
        d, fa, fb = d[pair, i, j], fa[pair, i], fb[pair, j]
        order = np.lexsort((fb, fa, d, pair))
        order = order[np.diff(pair[order], prepend=-1) > 0]
        to = some.start + pair[order]
        least[to], frames[0][to], frames[1][to] = d[order], fa[order], fb[order]
    return pa.StructArray.from_arrays([pa.array(least, mask=np.isnan(least)), pa.array(frames[0]), pa.array(frames[1])], ["d", "fa", "fb"])
