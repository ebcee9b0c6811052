"""Inside a task: what hides the objects of a few frames from their poses, as arrays over observations and objects.

Spark deals tracks by frame and unfolds what comes back; here are only the numbers of one batch of frames.
Small frames compare their objects pairwise. In crowded ones each object, in order of range, asks its bin for the nearest
corner so far, so they take time in proportion to their objects.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TWO_PI = 2.0 * math.pi
#: Pairs of objects that are compared at once, and objects of observations that are handed back at once.
PAIRS, OBJECTS = 1 << 18, 1 << 18
#: The bin of no bearing, above all others, for the lowest of an object's bins.
NONE = 1 << 14
#: Columns of a frame's tracks; those of its egos follow.
TRACK = 7

OBJECT = pa.struct([("o", pa.int32()), ("rng", pa.float64()), ("rel", pa.float64()), ("in_fov", pa.bool_()), ("b", pa.int32()), ("near", pa.float64())])


def as_in_c(ufunc: np.ufunc, function: Callable[..., float]) -> Callable[..., np.ndarray]:
    """NumPy's function where its values are the C library's to the last bit, else Arrow's, else the C library's, one by one.

    A bearing at the very edge of a bin falls to one side or the other by its last bit; SQL engines take the C library's.
    Arrow calls the C library in a loop of its own, at a thirtieth of the time that Python takes for each value.
    """
    probe = np.random.default_rng(7).normal(size=(ufunc.nin, 512)) * 9.0
    wanted = [function(*p) for p in zip(*probe.tolist(), strict=True)]
    for f in (ufunc, in_arrow(function.__name__)):
        if np.array_equal(f(*probe), wanted):
            return f
    each = np.frompyfunc(lambda *a: function(*a) if all(map(math.isfinite, a)) else math.nan, ufunc.nin, 1)
    return lambda *a: np.asarray(each(*a), dtype=np.float64)


def in_arrow(name: str) -> Callable[..., np.ndarray]:
    """Arrow's function of a name over arrays of any one shape."""
    return lambda *a: pc.call_function(name, [pa.array(np.asarray(x, dtype=np.float64).ravel()) for x in a]).to_numpy(zero_copy_only=False).reshape(np.shape(a[0]))


def box_corners(x, y, dx, dy, yaw) -> list[tuple[np.ndarray, np.ndarray]]:
    """The corners of boxes, clockwise from the front left."""
    c, s = (as_in_c(f, g)(yaw) for f, g in ((np.cos, math.cos), (np.sin, math.sin)))
    halves = [(dx / 2.0 * a, dy / 2.0 * b) for a, b in ((1, 1), (1, -1), (-1, -1), (-1, 1))]
    return [(u * c - v * s + x, u * s + v * c + y) for u, v in halves]


def wrap(a: np.ndarray) -> np.ndarray:
    return a + math.pi - TWO_PI * np.floor((a + math.pi) / TWO_PI) - math.pi


def bins_of(bearing: np.ndarray, half: float, bins: int) -> np.ndarray:
    return np.clip(np.floor((bearing + half) / (half * 2.0 / bins)), 0, bins - 1).astype(np.int16)


def farthest(ids: np.ndarray, rng: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Of objects that share a track the farthest; ids are in order within rows."""
    new = np.ones(ids.shape, dtype=bool)
    new[:, 1:] = ids[:, 1:] != ids[:, :-1]
    if new.all():
        return there
    run = np.cumsum(new.ravel()) - 1
    far = np.full(run[-1] + 1, -np.inf)
    np.maximum.at(far, run, np.where(there, rng, -np.inf).ravel())
    return there & (rng >= far[run].reshape(rng.shape))


def by_pairs(before, rng, near, cbin, ks, lo, hi, back, casts) -> np.ndarray:
    """The blocker's place for each object, -1 for none: the least corner, range and track of those before it that cover its bin.

    before: for each occluder, each object and each observation. Observations come last here, so that each occluder is held
    against all objects in long runs.
    """
    rng, near, cbin, hi, low, round_back, *ks = (np.ascontiguousarray(a.T) for a in (rng, near, cbin, hi, np.where(casts, lo, NONE).astype(np.int16), back & casts, *ks))
    least, who = np.full(cbin.shape, np.inf), np.full(cbin.shape, -1, dtype=np.int16)
    for c in np.flatnonzero((low < NONE).any(1)):
        covers = (cbin >= low[c]) & (cbin <= hi[c])
        if round_back[c].any():
            round_ = (cbin >= hi[c]) | (cbin <= low[c])
            for k in ks:
                round_ |= cbin == k[c]
            covers = np.where(round_back[c], round_ & (cbin >= 0), covers)
        covers &= before[c]
        ties = covers & (near[c] == least)
        covers &= near[c] < least
        if ties.any():
            o, of = np.nonzero(ties & (who >= 0))
            nearer = rng[c, of] < rng[who[o, of], of]
            covers[o[nearer], of[nearer]] = True
        np.copyto(least, near[c], where=covers)
        np.copyto(who, np.int16(c), where=covers)
    return np.ascontiguousarray(who.T)


def by_steps(ids, rng, near, cbin, ks, lo, hi, back, casts, bins: int) -> np.ndarray:
    """The same for crowded frames, by each bin's nearest corner so far."""
    out = np.full(ids.shape, -1, dtype=np.int64)
    for row in range(len(ids)):
        order = np.lexsort((near[row], ids[row], rng[row]))
        least, who = np.full(bins, np.inf), np.full(bins, -1, dtype=np.int64)
        key = list(zip(rng[row][order].tolist(), ids[row][order].tolist(), strict=True))
        i = 0
        while i < len(order):
            j = i + 1
            while j < len(order) and key[j] == key[i]:
                j += 1
            for x in order[i:j]:
                if cbin[row, x] >= 0:
                    out[row, x] = who[cbin[row, x]]
            for x in order[i:j]:
                if casts[row, x] and lo[row, x] < NONE:
                    a, b = lo[row, x], hi[row, x]
                    parts = [slice(b, bins), slice(0, a + 1), *(slice(k[row, x], k[row, x] + 1) for k in ks if k[row, x] >= 0)] if back[row, x] else [slice(a, b + 1)]
                    for part in parts:
                        nearer = near[row, x] < least[part]
                        least[part][nearer], who[part][nearer] = near[row, x], x
            i = j
    return out


def views(ids, occluder, x, y, corners, pose, ego, fovs: Sequence[float], bins: int, repeats: bool, crowd: int) -> Iterator[tuple]:
    """For each field of view (kept, rng, rel, in_fov, blocker, its near): arrays over observations and objects."""
    sx, sy, h = (p[:, None] for p in pose)
    dx, dy = x - sx, y - sy
    atan2 = as_in_c(np.arctan2, math.atan2)
    rng, rel = np.sqrt(dx * dx + dy * dy), wrap(atan2(dy, dx) - h)
    near, rels = np.full(rng.shape, np.inf), []
    for cx, cy in corners:
        u, v = cx - sx, cy - sy
        near = np.minimum(near, np.sqrt(u * u + v * v))
        rels.append(wrap(atan2(v, u) - h))
    there = np.ones(rng.shape, dtype=bool) if ego is None else ids != ego[:, None]
    kept = there if repeats else farthest(ids, rng, there)
    if ids.shape[1] <= crowd:
        a = np.ascontiguousarray(rng.T)
        before, same = a[:, None] < a[None], a[:, None] == a[None]
        if np.count_nonzero(same) > rng.size:
            before |= same & (ids.T[:, None] < ids.T[None])
    for fov in fovs:
        half = math.radians(fov) / 2.0
        in_fov = np.abs(rel) <= half
        cbin = np.where(in_fov, bins_of(rel, half, bins), -1).astype(np.int16)
        ks = [np.where((r >= -half) & (r <= half), bins_of(r, half, bins), -1).astype(np.int16) for r in rels]
        lo, hi = np.minimum.reduce([np.where(k < 0, NONE, k).astype(np.int16) for k in ks]), np.maximum.reduce(ks)
        back = (hi - lo > bins // 2) & (half * 2.0 >= TWO_PI - 1e-6)
        given = (rng, near, cbin, ks, lo, hi, back, occluder & there)
        b = by_steps(ids, *given, bins) if ids.shape[1] > crowd else by_pairs(before, *given)
        yield kept, rng, rel, in_fov, b, np.where(b >= 0, np.take_along_axis(near, np.maximum(b, 0), 1), np.nan)


def tallies(seen: tuple, x, y, limits: dict) -> dict[str, np.ndarray]:
    """Counts of an observation's objects, those that depend on a range for each range."""
    kept, rng, _, in_fov, _, near = seen
    blocked = rng > near + limits["margin_m"]
    nearby = kept & (rng <= limits["nearby_m"])
    dx, dy = x - limits["centre"][0], y - limits["centre"][1]
    zone = kept & (np.sqrt(dx * dx + dy * dy) <= limits["conflict_m"])
    out = {"n_objects_total": kept, "n_out_of_fov": kept & ~in_fov, "n_nearby_total": nearby, "n_conflict_zone_total": zone}
    for i, r in enumerate(limits["ranges"]):
        inside = in_fov & (rng > limits["near_blind_m"]) & (rng <= r)
        visible = inside & ~blocked
        out |= {f"n_visible_onboard_{i}": kept & visible, f"n_occluded_{i}": kept & inside & blocked, f"n_out_of_range_{i}": kept & in_fov & ~inside, f"n_nearby_visible_{i}": nearby & visible, f"n_conflict_zone_visible_{i}": zone & visible}
    return {k: v.sum(1, dtype=np.int64) for k, v in out.items()}


def objects(kept, rng, rel, in_fov, b, near) -> pa.Array:
    """Lists of objects from arrays over observations, fields of view and objects."""
    place = np.broadcast_to(np.arange(kept.shape[2], dtype=np.int32), kept.shape)
    none = b[kept] < 0
    values = [pa.array(place[kept]), pa.array(rng[kept]), pa.array(rel[kept]), pa.array(in_fov[kept]), pa.array(b[kept].astype(np.int32), mask=none), pa.array(near[kept], mask=none)]
    offsets = np.concatenate([[0], np.cumsum(kept.sum(2).ravel())]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(values, fields=list(OBJECT)))


def names(limits: dict | None) -> list[str]:
    """The names of tallies: those that do not depend on a range, then those of each range."""
    if not limits:
        return []
    met = limits.get("pairs", False)
    each = ("n_visible_onboard", "n_occluded", "n_out_of_range", "n_nearby_visible", "n_conflict_zone_visible", *(("nm_both_visible", "nm_at_least_one_visible", "nm_ego_relevant_aware") if met else ()))
    return ["n_objects_total", "n_out_of_fov", "n_nearby_total", "n_conflict_zone_total", *(("nm_total", "nm_ego_relevant") if met else ()), *(f"{n}_{i}" for i in range(len(limits["ranges"])) for n in each)]


def parties(pairs: Sequence[pa.Array], ids: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> tuple:
    """Pairs of tracks that are both in their frame: how many a frame has, for each side the place of its first row and its rows, and their events."""
    a, b, events = (c.flatten().to_numpy(zero_copy_only=False) for c in pairs)
    frame = np.repeat(np.arange(len(sizes)), np.diff(pairs[0].offsets.to_numpy()))
    known = np.unique(ids)
    # ids are in order within frames, so these keys are in order
    keys = np.repeat(np.arange(len(sizes)), sizes) * (len(known) + 1) + np.searchsorted(known, ids)
    sides = []
    for side in (a, b):
        code = np.searchsorted(known, side)
        found = known[np.minimum(code, len(known) - 1)] == side
        key = frame * (len(known) + 1) + np.where(found, code, len(known))
        low = np.searchsorted(keys, key, side="left")
        sides.append((low - first[frame], np.searchsorted(keys, key, side="right") - low))
    both = (sides[0][1] > 0) & (sides[1][1] > 0)
    return np.bincount(frame[both], minlength=len(sizes)), [(low[both], rows[both]) for low, rows in sides], events[both]


def meetings(seen: tuple, limits: dict, met: tuple, frame: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of an observation's near misses. met: `parties`; frame: the observations' frames."""
    kept, rng, _, in_fov, _, near = seen
    n, sides, events = met
    starts, of = np.cumsum(n) - n, n[frame]
    row = np.repeat(np.arange(len(frame)), of)
    pair = np.arange(len(row)) - np.repeat(np.cumsum(of) - of, of) + starts[frame][row]
    there, places = np.ones(len(row), dtype=bool), []
    for low, rows in sides:
        place, found = low[pair], kept[row, low[pair]]
        # of rows that share a track, the first that counts
        for k in range(1, int(rows.max(initial=1))):
            more = ~found & (rows[pair] > k)
            place[more] = low[pair][more] + k
            found[more] = kept[row[more], place[more]]
        places.append(place)
        there &= found
    row, (a, b), weight = row[there], (p[there] for p in places), events[pair][there]
    total = lambda c: np.bincount(row, weights=np.where(c, weight, 0), minlength=len(frame)).astype(np.int64)
    nearby = rng <= limits["nearby_m"]
    relevant = nearby[row, a] | nearby[row, b]
    out = {"nm_total": total(True), "nm_ego_relevant": total(relevant)}
    clear = in_fov & (rng > limits["near_blind_m"]) & ~(rng > near + limits["margin_m"])
    for i, r in enumerate(limits["ranges"]):
        visible = clear & (rng <= r)
        va, vb = visible[row, a], visible[row, b]
        out |= {f"nm_both_visible_{i}": total(va & vb), f"nm_at_least_one_visible_{i}": total(va | vb), f"nm_ego_relevant_aware_{i}": total(relevant & (va | vb))}
    return out


def unfolded(columns: Sequence[pa.Array], mount: tuple[float, float]) -> tuple:
    """Flat arrays of tracks (ids, occluders, x, y, eight corner coordinates) and of poses (sensor's x, y, heading, ids or None); sizes of frames, then
    each pose's frame and place in it, and each frame's first track."""
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in columns]
    ids, occluder, x, y, dx, dy, yaw, ego_x, ego_y, heading, *ego = flat
    cos, sin = (as_in_c(f, g)(heading) for f, g in ((np.cos, math.cos), (np.sin, math.sin)))
    forward, left = mount
    sizes, poses = (np.diff(columns[k].offsets.to_numpy()) for k in (0, TRACK))
    frame = np.repeat(np.arange(len(sizes)), poses)
    tracks = [ids, occluder, x, y, *(a for corner in box_corners(x, y, dx, dy, yaw) for a in corner)]
    of_pose = [ego_x + forward * cos - left * sin, ego_y + forward * sin + left * cos, heading, ego[0] if ego else None]
    return tracks, of_pose, sizes, frame, np.arange(len(frame)) - (np.cumsum(poses) - poses)[frame], np.cumsum(sizes) - sizes


def binned(columns: Sequence[pa.Array], half: float, bins: int, mount: tuple[float, float]) -> pa.Array:
    """For each frame a list of its poses' objects: ids of ego and track, bins of centre and corners. columns: as in `observed`."""
    (ids, _, x, y, *corners), (sx, sy, h, ego), sizes, frame, _, first = unfolded(columns, mount)
    n = sizes[frame]
    p = np.repeat(np.arange(len(frame)), n)
    o = np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[frame], n)
    atan2 = as_in_c(np.arctan2, math.atan2)
    fields = {"ego": pa.array(ego[p]), "track_id": pa.array(ids[o])}
    for name, cx, cy in zip(("cbin", "k0", "k1", "k2", "k3"), (x, *corners[::2]), (y, *corners[1::2]), strict=True):
        bearing = wrap(atan2(cy[o] - sy[p], cx[o] - sx[p]) - h[p])
        inside = (bearing >= -half) & (bearing <= half)
        fields[name] = pa.array(bins_of(np.where(inside, bearing, 0.0), half, bins).astype(np.int32), mask=~inside)
    ends = np.concatenate([[0], np.cumsum(np.bincount(frame, weights=n, minlength=len(sizes)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def of_sizes(sizes: np.ndarray, frame: np.ndarray, first: np.ndarray, crowd: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Observations of frames of one size, some at a time and in order, and the places of their tracks."""
    n_of = sizes[frame]
    for n in np.unique(n_of):
        of_size = np.flatnonzero(n_of == n)
        step = max(1, PAIRS // max(1, min(int(n), crowd) * int(n)))
        for some in (of_size[i : i + step] for i in range(0, len(of_size), step)):
            yield some, first[frame[some]][:, None] + np.arange(n)


def seen_from(tracks: list, of_pose: list, at: np.ndarray, some: np.ndarray, fovs: Sequence[float], bins: int, repeats: bool, crowd: int) -> list[tuple]:
    """`views` of some observations."""
    ids, occluder, x, y, *corner = (a[at] for a in tracks)
    *pose, ego = of_pose
    return list(views(ids, occluder, x, y, list(zip(corner[::2], corner[1::2], strict=True)), [a[some] for a in pose], None if ego is None else ego[some], fovs, bins, repeats, crowd))


def times_seen(columns: Sequence[pa.Array], fovs: Sequence[float], bins: int, crowd: int, limits: dict, mount: tuple[float, float]) -> pa.Array:
    """For each frame a list of its tracks: place, poses, and for each field of view the poses that see it. columns: as in `observed`.

    Rows that share a track are seen where the farthest of them is, and come once.
    """
    tracks, of_pose, sizes, frame, _, first = unfolded(columns, mount)
    poses = np.diff(columns[TRACK].offsets.to_numpy())
    ids, whose = tracks[0], np.repeat(np.arange(len(sizes)), sizes)
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (ids[1:] != ids[:-1]) | (whose[1:] != whose[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
    seen = np.zeros((len(fovs), len(ids)), dtype=np.int64)
    for some, at in of_sizes(sizes, frame, first, crowd):
        starts = np.flatnonzero(np.diff(frame[some], prepend=-1))
        for v, (kept, rng, _, in_fov, _, near) in enumerate(seen_from(tracks, of_pose, at, some, fovs, bins, False, crowd)):
            sees = kept & in_fov & (rng > limits["near_blind_m"]) & (rng <= limits["range_m"]) & ~(rng > near + limits["margin_m"])
            if not new[at].all():
                row, o = np.nonzero(sees)
                sees = np.zeros_like(sees)
                sees[row, head[at][row, o] - at[row, 0]] = True
            seen[v][at[starts]] += np.add.reduceat(sees, starts, axis=0, dtype=np.int64)
    fields = {"p": pa.array((np.arange(len(ids)) - first[whose])[new].astype(np.int32)), "n": pa.array(poses[whose][new].astype(np.int64)), **{f"v{v}": pa.array(s[new]) for v, s in enumerate(seen)}}
    ends = np.concatenate([[0], np.cumsum(np.bincount(whose[new], minlength=len(sizes)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def observed(columns: Sequence[pa.Array], fovs: Sequence[float], bins: int, repeats: bool, crowd: int, limits: dict | None, mount: tuple[float, float]) -> pa.Array:
    """For each frame a list of observations: pose, field of view, tallies if limits are given, and the objects.

    columns: lists of ids, whether they are occluders, x, y, length, width, yaw, then of the egos' x, y, heading and, for egos that
    are left out of their scene, their ids; with limits["pairs"] the near misses' ids of both tracks and their events, too.
    mount: the sensor's place on its ego, forward and to the left.
    """
    columns, pairs = (columns[:-3], columns[-3:]) if limits and limits.get("pairs") else (columns, None)
    tracks, of_pose, sizes, frame, pose, first = unfolded(columns, mount)
    poses = np.diff(columns[TRACK].offsets.to_numpy())
    met = parties(pairs, tracks[0], sizes, first) if pairs else None
    parts, order = [], []
    for some, at in of_sizes(sizes, frame, first, crowd):
        seen = seen_from(tracks, of_pose, at, some, fovs, bins, repeats, crowd)
        fields = {"e": np.repeat(pose[some], len(fovs)).astype(np.int32), "v": np.tile(np.arange(len(fovs), dtype=np.int32), len(some))}
        if limits:
            counted = [tallies(s, tracks[2][at], tracks[3][at], limits) | (meetings(s, limits, met, frame[some]) if met else {}) for s in seen]
            fields |= {k: np.stack([t[k] for t in counted], 1).ravel() for k in names(limits)}
        fields = {k: pa.array(v) for k, v in fields.items()}
        if not limits or limits["objects"]:
            fields["os"] = objects(*(np.stack(a, 1) for a in zip(*seen, strict=True)))
        parts.append(pa.StructArray.from_arrays(list(fields.values()), list(fields)))
        order.append(np.repeat(some, len(fovs)))
    ends = np.concatenate([[0], np.cumsum(poses * len(fovs))]).astype(np.int32)
    together = pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(order), kind="stable")))
    return pa.ListArray.from_arrays(pa.array(ends), together)


def batches(columns: Sequence[pa.Array], n_views: int) -> Iterator[list[pa.Array]]:
    """The columns in pieces of whole frames that hand back some OBJECTS at most, or one frame."""
    given = np.diff(columns[0].offsets.to_numpy()).astype(np.int64) * np.diff(columns[TRACK].offsets.to_numpy()) * n_views
    start, total = 0, np.concatenate([[0], np.cumsum(given)])
    while start < len(given):
        stop = max(start + 1, int(np.searchsorted(total, total[start] + OBJECTS, side="right")) - 1)
        yield [c.slice(start, stop - start) for c in columns]
        start = stop
