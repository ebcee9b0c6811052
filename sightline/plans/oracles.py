"""The registered queries as DuckDB SQL, in relational form: joins where the operators use arrays."""

from __future__ import annotations

import math
from collections.abc import Sequence

from ..operators import config as c
from .fixture import _REPEATED as REPEATED
from .fixture import duck_ctes

PI = repr(math.pi)
TWO_PI = repr(2 * math.pi)


def wrap(x: str) -> str:
    return f"(({x}) + {PI} - {TWO_PI} * floor((({x}) + {PI}) / {TWO_PI}) - {PI})"


def egos_cte(positions: int = 15, name: str = "egos") -> str:
    """The poses, written out: lane by lane, evenly spaced from one end to the other."""
    return f"""{name} AS (SELECT lane * {positions} + i AS ego_id, approach, i AS pos, x0 + i / {max(positions - 1, 1)}::DOUBLE * (x1 - x0) AS ego_x, y0 + i / {max(positions - 1, 1)}::DOUBLE * (y1 - y0) AS ego_y, ego_h FROM (VALUES
        (0, 'north', 7e0, 35e0, 7e0, 8e0, -15707963267948966e-16::DOUBLE), (1, 'south', 8e0, -15e0, 8e0, 8e0, 15707963267948966e-16::DOUBLE),
        (2, 'east', 35e0, 8e0, 8e0, 8e0, 3141592653589793e-15::DOUBLE), (3, 'west', -20e0, 8e0, 8e0, 8e0, 0e0)) AS l(lane, approach, x0, y0, x1, y1, ego_h) CROSS JOIN range({positions}) AS r(i))"""


def vehicles_cte(heading: str, name: str = "vegos", where: str = "class_name IN ('car', 'truck')") -> str:
    to = f"atan2({c.CENTRE[1]} - bbox_center_y, {c.CENTRE[0]} - bbox_center_x)"
    dx, dy = f"({c.CENTRE[0]} - bbox_center_x)", f"({c.CENTRE[1]} - bbox_center_y)"
    return f"""{name} AS (SELECT frame_idx, track_id AS ego_track_id, bbox_center_x AS ego_x, bbox_center_y AS ego_y, {to if heading == "inward" else "bbox_yaw"} AS ego_h,
        sqrt({dx} * {dx} + {dy} * {dy}) AS ego_dist_to_center, abs({wrap(f"{to} - bbox_yaw")}) < {math.pi / 2!r} AS ego_inbound FROM tracks WHERE {where})"""


def vis_ctes(fov: float, name: str, egos: str = "egos", scene: str = "tracks", key: str = "ego_id", by_frame: bool = False) -> str:
    """CTEs ending in {name}: every object from every ego at one field of view, with its blocker."""
    half, bins = math.radians(fov) / 2.0, 360
    corner = []
    for a, b in ((1, 1), (1, -1), (-1, -1), (-1, 1)):
        u, v = f"(t.bbox_dx / 2.0 * {a})", f"(t.bbox_dy / 2.0 * {b})"
        corner.append((f"({u} * cos(t.bbox_yaw) - {v} * sin(t.bbox_yaw) + t.bbox_center_x - e.sx)", f"({u} * sin(t.bbox_yaw) + {v} * cos(t.bbox_yaw) + t.bbox_center_y - e.sy)"))
    on = "ON t.frame_idx = e.frame_idx AND t.track_id <> e.ego_track_id" if by_frame else "ON TRUE"
    place = lambda x: f"CAST(greatest(0, least({bins - 1}, floor(({x} + {half!r}) / ({half!r} * 2.0 / {bins})))) AS INTEGER)"
    ks = ", ".join(f"CASE WHEN rel{i} BETWEEN {-half!r} AND {half!r} THEN {place(f'rel{i}')} END AS k{i}" for i in range(4))
    back = "c.hi - c.lo > 180" if fov >= 360 else "FALSE"
    return f"""{name}_p AS (SELECT *, ego_x + 1.5 * cos(ego_h) - 0.0 * sin(ego_h) AS sx, ego_y + 1.5 * sin(ego_h) + 0.0 * cos(ego_h) AS sy FROM {egos}),
    {name}_d AS (SELECT t.frame_idx, e.{key}, e.ego_h AS h, t.track_id, t.class_name, t.bbox_center_x AS x, t.bbox_center_y AS y, t.bbox_dz AS height, t.score, t.bbox_center_x - e.sx AS dx, t.bbox_center_y - e.sy AS dy,
        {", ".join(f"{u} AS u{i}, {v} AS v{i}" for i, (u, v) in enumerate(corner))} FROM {scene} AS t JOIN {name}_p AS e {on}),
    {name}_g AS (SELECT frame_idx, {key}, track_id, class_name, x, y, height, score, sqrt(dx * dx + dy * dy) AS rng, {wrap("atan2(dy, dx) - h")} AS rel,
        least({", ".join(f"sqrt(u{i} * u{i} + v{i} * v{i})" for i in range(4))}) AS near, {", ".join(f"{wrap(f'atan2(v{i}, u{i}) - h')} AS rel{i}" for i in range(4))} FROM {name}_d),
    {name}_b AS (SELECT * EXCLUDE (rel0, rel1, rel2, rel3), abs(rel) <= {half!r} AS in_fov, CASE WHEN abs(rel) <= {half!r} THEN {place("rel")} END AS cbin, {ks} FROM {name}_g),
    {name}_c AS (SELECT *, list_min([k0, k1, k2, k3]) AS lo, list_max([k0, k1, k2, k3]) AS hi FROM {name}_b),
    {name}_j AS (SELECT o.frame_idx, o.{key}, o.track_id, c.near, c.track_id AS cid, c.height AS ch, c.class_name AS cc,
        row_number() OVER (PARTITION BY o.frame_idx, o.{key}, o.track_id ORDER BY c.near, c.rng, c.track_id) AS n
        FROM {name}_c AS o JOIN {name}_c AS c ON o.frame_idx = c.frame_idx AND o.{key} = c.{key} AND (c.rng < o.rng OR (c.rng = o.rng AND c.track_id < o.track_id))
        WHERE c.class_name IN ('car', 'truck') AND c.lo IS NOT NULL AND o.cbin IS NOT NULL
          AND CASE WHEN {back} THEN o.cbin >= c.hi OR o.cbin <= c.lo OR coalesce(o.cbin = c.k0, FALSE) OR coalesce(o.cbin = c.k1, FALSE) OR coalesce(o.cbin = c.k2, FALSE) OR coalesce(o.cbin = c.k3, FALSE)
              ELSE o.cbin BETWEEN c.lo AND c.hi END),
    {name} AS (SELECT o.frame_idx, o.{key}, {fov!r}::DOUBLE AS fov_deg, o.track_id, o.class_name, o.x, o.y, o.height, o.score, o.rng, o.rel, o.in_fov,
        coalesce(o.rng > j.near + 0.5, FALSE) AS blocked, j.cid, j.near AS bnear, j.ch, j.cc FROM {name}_c AS o
        LEFT JOIN {name}_j AS j ON o.frame_idx = j.frame_idx AND o.{key} = j.{key} AND o.track_id = j.track_id AND j.n = 1)"""


def seen_cte(source: str, name: str, ranges: Sequence[float] = (35.0,)) -> str:
    """Reasons for one or more limits of range."""
    values = ", ".join(f"({r!r}::DOUBLE)" for r in ranges)
    return f"""{name}_r AS (SELECT *, CASE WHEN NOT in_fov THEN 'out_of_fov' WHEN NOT (rng > 1.5 AND rng <= range_m) THEN 'out_of_range' WHEN blocked THEN 'occluded' ELSE 'visible' END AS reason
        FROM {source} CROSS JOIN (VALUES {values}) AS r(range_m)),
    {name} AS (SELECT *, reason = 'visible' AS visible, CASE WHEN reason = 'occluded' THEN cid END AS occluded_by, CASE WHEN reason = 'occluded' THEN cc END AS blocker_class FROM {name}_r)"""


def obs_cte(seen: str, name: str, key: str = "ego_id") -> str:
    zone = f"sqrt((x - {c.CENTRE[0]}) * (x - {c.CENTRE[0]}) + (y - {c.CENTRE[1]}) * (y - {c.CENTRE[1]})) <= 20.0"
    return f"""{name} AS (SELECT *, n_visible_onboard / nullif(n_objects_total, 0)::DOUBLE AS visibility_ratio_onboard, n_nearby_visible / nullif(n_nearby_total, 0)::DOUBLE AS nearby_visibility_ratio,
        n_conflict_zone_visible / nullif(n_conflict_zone_total, 0)::DOUBLE AS conflict_zone_visibility_ratio FROM (
        SELECT frame_idx, {key}, fov_deg, range_m, count(*) AS n_objects_total, count(*) FILTER (visible) AS n_visible_onboard, count(*) FILTER (reason = 'occluded') AS n_occluded,
            count(*) FILTER (reason = 'out_of_fov') AS n_out_of_fov, count(*) FILTER (reason = 'out_of_range') AS n_out_of_range, count(*) FILTER (rng <= 15.0) AS n_nearby_total,
            count(*) FILTER (rng <= 15.0 AND visible) AS n_nearby_visible, count(*) FILTER ({zone}) AS n_conflict_zone_total, count(*) FILTER ({zone} AND visible) AS n_conflict_zone_visible
        FROM {seen} GROUP BY 1, 2, 3, 4) AS q)"""


def nm_cte(seen: str, name: str) -> str:
    return f"""{name} AS (SELECT a.frame_idx, a.ego_id, a.fov_deg, a.range_m, count(*) AS nm_total, count(*) FILTER (a.visible AND b.visible) AS nm_both_visible, count(*) FILTER (a.visible OR b.visible) AS nm_at_least_one_visible,
        count(*) FILTER (a.rng <= 15 OR b.rng <= 15) AS nm_ego_relevant, count(*) FILTER ((a.rng <= 15 OR b.rng <= 15) AND (a.visible OR b.visible)) AS nm_ego_relevant_aware
        FROM nm JOIN {seen} AS a ON a.frame_idx = nm.frame_idx AND a.track_id = nm.track_id_a
        JOIN {seen} AS b ON b.frame_idx = nm.frame_idx AND b.track_id = nm.track_id_b AND b.ego_id = a.ego_id AND b.fov_deg = a.fov_deg AND b.range_m = a.range_m GROUP BY 1, 2, 3, 4)"""


def strided_cte(step: int, name: str = "scene") -> str:
    return f"{name} AS (SELECT * FROM tracks WHERE frame_idx IN (SELECT frame_idx FROM (SELECT frame_idx, row_number() OVER (ORDER BY frame_idx) - 1 AS pos FROM (SELECT DISTINCT frame_idx FROM tracks) AS f) AS g WHERE pos % {step} = 0))"


def evenly_cte(k: int, name: str = "sampled") -> str:
    return f"""{name}_f AS (SELECT frame_idx, row_number() OVER (ORDER BY frame_idx) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT frame_idx FROM tracks) AS f),
    {name} AS (SELECT frame_idx FROM {name}_f WHERE pos IN (SELECT i * (n - 1) // greatest(least(n, {k}) - 1, 1) FROM (SELECT max(n) AS n FROM {name}_f) AS m, range({k}) AS r(i) WHERE i < least(n, {k})))"""


def query(final: str, *ctes: str) -> str:
    return f"WITH {duck_ctes()}{''.join(', ' + x for x in ctes)}\n{final}"


def r(*names: str) -> str:
    return ", ".join(f"round({n.split(' AS ')[0]}, 6) AS {n.split(' AS ')[-1]}" for n in names)


GRID120 = (egos_cte(), vis_ctes(120.0, "v"), seen_cte("v", "s"))
BOTH = (egos_cte(), vis_ctes(120.0, "v1"), vis_ctes(360.0, "v2"), "v AS (SELECT * FROM v1 UNION ALL SELECT * FROM v2)", seen_cte("v", "s"))
OBS = (*GRID120, obs_cte("s", "o"))
SHARES = ", ".join(f"avg(CASE WHEN reason = '{x}' THEN 1.0 ELSE 0.0 END) AS share_{x}" for x in c.REASONS)
MEANS = "avg(visibility_ratio_onboard) AS int_wide, avg(nearby_visibility_ratio) AS nearby, avg(conflict_zone_visibility_ratio) AS conflict, avg(n_objects_total) AS total, avg(n_visible_onboard) AS visible, avg(n_occluded) AS occluded, avg(n_out_of_fov) AS out_fov, avg(n_out_of_range) AS out_range"
MEAN_NAMES = ("int_wide", "nearby", "conflict", "total", "visible", "occluded", "out_fov", "out_range")
PERSPECTIVES = "persp AS (SELECT frame_idx, track_id_a AS ego_track_id, track_id_b AS partner_id FROM nm WHERE class_a IN ('car', 'truck') UNION ALL SELECT frame_idx, track_id_b, track_id_a FROM nm WHERE class_b IN ('car', 'truck'))"


def partner_ctes(wanted: str, extra: str, heading: str = "yaw") -> tuple[str, ...]:
    pick = f"(frame_idx, track_id) IN (SELECT frame_idx, ego_track_id FROM {wanted})"
    a, b = (vis_ctes(f, n, "vegos", key="ego_track_id", by_frame=True) for f, n in ((120.0, "v1"), (360.0, "v2")))
    return (vehicles_cte(heading, where=pick), a, b, "v AS (SELECT * FROM v1 UNION ALL SELECT * FROM v2)", seen_cte("v", "s"),
        f"rows AS (SELECT w.frame_idx, w.ego_track_id, w.partner_id{extra}, s.fov_deg, s.visible, s.reason, s.rng AS partner_range, abs(degrees(s.rel)) AS partner_bearing_abs_deg FROM {wanted} AS w JOIN s ON s.frame_idx = w.frame_idx AND s.ego_track_id = w.ego_track_id AND s.track_id = w.partner_id)")


TTC = (PERSPECTIVES, *partner_ctes("persp", ""))
PAIRS = "pairs AS (SELECT fov_deg, least(ego_track_id, partner_id) AS a, greatest(ego_track_id, partner_id) AS b, first(visible ORDER BY partner_range, frame_idx, ego_track_id) AS closest, bool_or(visible) AS ever FROM rows GROUP BY 1, 2, 3)"
D2 = "(a.bbox_center_x - b.bbox_center_x) * (a.bbox_center_x - b.bbox_center_x) + (a.bbox_center_y - b.bbox_center_y) * (a.bbox_center_y - b.bbox_center_y)"
CANDIDATES = f"cand AS (SELECT DISTINCT a.track_id AS ego_track_id, b.track_id AS partner_id FROM tracks AS a JOIN tracks AS b ON a.frame_idx = b.frame_idx AND a.track_id <> b.track_id WHERE a.class_name IN ('car', 'truck') AND {D2} <= 900.0)"
CROSSINGS = f"""crossing AS (SELECT ego_track_id, partner_id, d AS crossing_m, fa AS ego_frame, fb AS partner_frame, abs(fa - fb) * 0.1 AS pet_s FROM (
    SELECT ego_track_id, partner_id, a.frame_idx AS fa, b.frame_idx AS fb, sqrt({D2}) AS d, row_number() OVER (PARTITION BY ego_track_id, partner_id ORDER BY sqrt({D2}), a.frame_idx, b.frame_idx) AS n
    FROM cand JOIN tracks AS a ON a.track_id = ego_track_id JOIN tracks AS b ON b.track_id = partner_id) AS q WHERE n = 1 AND d <= 2.0)"""
CONFLICTS = f"""conflict AS (SELECT ego_track_id, partner_id, class_name AS partner_class, pet_s, sqrt(d2) AS min_sep_m, frame_idx FROM (
    SELECT ego_track_id, partner_id, pet_s, a.frame_idx, {D2} AS d2, row_number() OVER (PARTITION BY ego_track_id, partner_id ORDER BY {D2}, a.frame_idx) AS n
    FROM crossing JOIN tracks AS a ON a.track_id = ego_track_id JOIN tracks AS b ON b.track_id = partner_id AND b.frame_idx = a.frame_idx WHERE pet_s <= 2.0) AS q
    JOIN (SELECT track_id, first(class_name ORDER BY frame_idx) AS class_name FROM tracks GROUP BY 1) AS k ON k.track_id = partner_id WHERE n = 1)"""
PET = (CANDIDATES, CROSSINGS, CONFLICTS)
NEAREST = f"""near AS (SELECT o.frame_idx, o.ego_id, o.visibility_ratio_onboard, o.n_occluded, o.n_out_of_fov, o.n_objects_total,
    min(sqrt((e.sx - t.bbox_center_x) * (e.sx - t.bbox_center_x) + (e.sy - t.bbox_center_y) * (e.sy - t.bbox_center_y))) AS d_sensor,
    min(sqrt((e.ego_x - t.bbox_center_x) * (e.ego_x - t.bbox_center_x) + (e.ego_y - t.bbox_center_y) * (e.ego_y - t.bbox_center_y))) AS d_center
    FROM o JOIN v_p AS e ON e.ego_id = o.ego_id LEFT JOIN (SELECT * FROM tracks WHERE class_name IN ('car', 'truck')) AS t ON t.frame_idx = o.frame_idx GROUP BY ALL)"""
BIN = " ".join(f"WHEN d_sensor >= {lo} {'' if math.isinf(hi) else f'AND d_sensor < {hi}'} THEN '[{lo:g},{hi:g})'" for lo, hi in zip(c.PROXIMITY_EDGES, c.PROXIMITY_EDGES[1:], strict=False))
VIEWS = (egos_cte(), vis_ctes(120.0, "v1"), vis_ctes(360.0, "v2"), "v AS (SELECT * FROM v1 UNION ALL SELECT * FROM v2)", seen_cte("v", "s"),
    "views AS (SELECT frame_idx, ego_id, track_id, first(score) AS score, bool_or(visible AND fov_deg = 120) AS v120, bool_or(visible AND fov_deg = 360) AS v360 FROM s GROUP BY 1, 2, 3)")
CLEARS = "coalesce(reason = 'occluded' AND {h} + (height - {h}) * (bnear / rng) >= ch, FALSE)"
TAUS = ", ".join(f"({t!r}::DOUBLE)" for t in c.CONFIDENCES)
SPEEDS = "speeds AS (SELECT *, sqrt(ddx * ddx + ddy * ddy) / nullif(df * 0.1, 0) AS speed_mps FROM (SELECT *, bbox_center_x - lag(bbox_center_x) OVER w AS ddx, bbox_center_y - lag(bbox_center_y) OVER w AS ddy, frame_idx - lag(frame_idx) OVER w AS df FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY frame_idx)) AS q)"
FOLLOWING = f"""foll AS (SELECT DISTINCT a.track_id, a.frame_idx FROM tracks AS a JOIN tracks AS b ON a.frame_idx = b.frame_idx WHERE a.class_name = 'car' AND b.class_name = 'truck' AND sqrt({D2}) < 15.0 AND sqrt({D2}) > 0.5
    AND abs({wrap("atan2(b.bbox_center_y - a.bbox_center_y, b.bbox_center_x - a.bbox_center_x) - a.bbox_yaw")}) < radians(30.0)),
    runs AS (SELECT track_id, min(frame_idx) AS first_frame, count(*) AS n_frames, count(*) * 0.1::DOUBLE AS seconds FROM (SELECT *, frame_idx - row_number() OVER (PARTITION BY track_id ORDER BY frame_idx) AS island FROM foll) AS q GROUP BY track_id, island)"""
LEADS = """leads AS (SELECT frame_idx, ego_id, count(*) AS total, count(*) FILTER (visible) AS seen, count(*) FILTER (blocker_class = 'truck') AS hidden,
    first(class_name ORDER BY rng, track_id) FILTER (class_name IN ('car', 'truck') AND visible AND abs(degrees(rel)) < 25 AND rng < 25) AS lead_class FROM s GROUP BY 1, 2)"""


def sweep_ctes(fovs: Sequence[float], ranges: Sequence[float], positions: int) -> tuple[str, ...]:
    vis = [vis_ctes(f, f"v{i}") for i, f in enumerate(fovs)]
    union = " UNION ALL ".join(f"SELECT * FROM v{i}" for i in range(len(fovs)))
    return (egos_cte(positions), *vis, f"v AS ({union})", seen_cte("v", "s", ranges), obs_cte("s", "o"), nm_cte("s", "m"),
        "full_obs AS (SELECT o.*, e.approach, coalesce(m.nm_total, 0) AS nm_total, coalesce(m.nm_both_visible, 0) AS nm_both_visible FROM o JOIN egos AS e USING (ego_id) LEFT JOIN m USING (frame_idx, ego_id, fov_deg, range_m))")


SENS = sweep_ctes(c.SENSITIVITY_FOVS, c.SENSITIVITY_RANGES, c.SENSITIVITY_POSITIONS)
SENS_TABLE = f"""sens AS (SELECT fov_deg, range_m, avg(visibility_ratio_onboard) AS visibility_mean, median(visibility_ratio_onboard) AS visibility_median, 1.0 - avg(visibility_ratio_onboard) AS cooperative_benefit,
    coalesce(sum(nm_both_visible) / nullif(sum(nm_total), 0)::DOUBLE, 0.0) AS nm_detectability_onboard, 1.0::DOUBLE AS nm_detectability_cooperative,
    {", ".join(f"avg(visibility_ratio_onboard) FILTER (approach = '{a}') AS vis_{a}" for a in c.APPROACHES)} FROM full_obs GROUP BY 1, 2)"""
RANGE = sweep_ctes(c.RANGE_FOVS, c.RANGES, 15)
RANGE_TABLE = "ranges AS (SELECT fov_deg, range_m, avg(visibility_ratio_onboard) AS int_wide, avg(nearby_visibility_ratio) AS nearby, avg(conflict_zone_visibility_ratio) AS conflict, avg(n_objects_total) AS total FROM full_obs GROUP BY 1, 2)"


def vehicle_ctes(heading: str) -> tuple[str, ...]:
    counts = ", ".join(f"coalesce(o.{n}, 0) AS {n}" for n in ("n_objects_total", "n_visible_onboard", "n_occluded", "n_out_of_fov", "n_out_of_range", "n_nearby_total", "n_nearby_visible", "n_conflict_zone_total", "n_conflict_zone_visible"))
    return (vehicles_cte(heading), vis_ctes(120.0, "v", "vegos", key="ego_track_id", by_frame=True), seen_cte("v", "s"), obs_cte("s", "o", "ego_track_id"),
        f"veh AS (SELECT e.frame_idx, e.ego_track_id, e.ego_x, e.ego_y, degrees(e.ego_h) AS ego_heading_deg, e.ego_dist_to_center, e.ego_inbound, {counts}, o.visibility_ratio_onboard, o.nearby_visibility_ratio, o.conflict_zone_visibility_ratio FROM vegos AS e LEFT JOIN o ON o.frame_idx = e.frame_idx AND o.ego_track_id = e.ego_track_id)",
        f"subsets AS (SELECT 'all' AS subset, * FROM veh UNION ALL SELECT 'region', * FROM veh WHERE ego_dist_to_center <= 28.0 UNION ALL SELECT 'region_inbound', * FROM veh WHERE ego_dist_to_center <= 28.0 AND ego_inbound)",
        f"vsum AS (SELECT subset, count(*) AS n_obs, count(DISTINCT frame_idx) AS frames, {MEANS} FROM subsets GROUP BY 1)")


OBS_COUNTS = "n_objects_total, n_visible_onboard, n_occluded, n_out_of_fov, n_out_of_range"
VEH_COLS = f"frame_idx, ego_track_id, {r('ego_x', 'ego_y', 'ego_heading_deg', 'ego_dist_to_center')}, ego_inbound, {OBS_COUNTS}, n_nearby_total, n_nearby_visible, n_conflict_zone_total, n_conflict_zone_visible, {r('visibility_ratio_onboard', 'nearby_visibility_ratio', 'conflict_zone_visibility_ratio')}"


def row_level(fov: float) -> str:
    return query("SELECT frame_idx, ego_id, track_id, reason, occluded_by FROM s", egos_cte(), vis_ctes(fov, "v"), seen_cte("v", "s"))


ORACLES: dict[str, str] = {
    "ego_grid": query(f"SELECT ego_id::BIGINT AS ego_id, approach, pos::BIGINT AS pos, {r('ego_x', 'ego_y', 'ego_h')}, (SELECT count(*) FROM tracks AS t WHERE sqrt((t.bbox_center_x - e.ego_x) * (t.bbox_center_x - e.ego_x) + (t.bbox_center_y - e.ego_y) * (t.bbox_center_y - e.ego_y)) <= 15.0) AS n_near FROM egos AS e", egos_cte()),
    "frame_stride": query("SELECT DISTINCT frame_idx FROM scene", strided_cte(10)),
    "frame_window": query("SELECT frame_idx, count(*) AS n FROM tracks WHERE frame_idx BETWEEN 20 AND 60 GROUP BY 1"),
    "frame_linspace_sample": query("SELECT frame_idx FROM sampled", evenly_cte(50)),
    "range_bearing": query(f"SELECT frame_idx, ego_id, track_id, {r('rng', 'rel', 'near')} FROM v_g", *GRID120[:2]),
    "box_corners": query("SELECT frame_idx, track_id, " + ", ".join(f"round(bbox_dx / 2.0 * {a} * cos(bbox_yaw) - bbox_dy / 2.0 * {b} * sin(bbox_yaw) + bbox_center_x, 6) AS x{i}, round(bbox_dx / 2.0 * {a} * sin(bbox_yaw) + bbox_dy / 2.0 * {b} * cos(bbox_yaw) + bbox_center_y, 6) AS y{i}" for i, (a, b) in enumerate(((1, 1), (1, -1), (-1, -1), (-1, 1)))) + " FROM tracks"),
    "corner_bins": query("SELECT frame_idx, ego_id, track_id, cbin::BIGINT AS cbin, k0::BIGINT AS k0, k1::BIGINT AS k1, k2::BIGINT AS k2, k3::BIGINT AS k3, lo::BIGINT AS lo, hi::BIGINT AS hi FROM v_c", *GRID120[:2]),
    "visibility_60": row_level(60.0), "visibility_120": row_level(120.0), "visibility_180": row_level(180.0), "visibility_360": row_level(360.0),
    "observation_counts": query(f"SELECT frame_idx, ego_id::BIGINT AS ego_id, {OBS_COUNTS}, {r('visibility_ratio_onboard')} FROM o", *OBS),
    "nearby_visibility": query(f"SELECT frame_idx, ego_id::BIGINT AS ego_id, n_nearby_total, n_nearby_visible, {r('nearby_visibility_ratio')} FROM o", *OBS),
    "conflict_zone_visibility": query(f"SELECT frame_idx, ego_id::BIGINT AS ego_id, n_conflict_zone_total, n_conflict_zone_visible, {r('conflict_zone_visibility_ratio')} FROM o", *OBS),
    "class_visibility": query("SELECT frame_idx, ego_id::BIGINT AS ego_id, class_name, count(*) FILTER (visible) AS n_visible, count(*) AS n_total FROM s GROUP BY 1, 2, 3", *GRID120),
    "near_miss_observations": query("SELECT frame_idx, ego_id::BIGINT AS ego_id, nm_total, nm_both_visible, nm_at_least_one_visible, nm_ego_relevant, nm_ego_relevant_aware FROM m", *GRID120, nm_cte("s", "m")),
    "near_miss_detectability": query("SELECT *, round(nm_both_visible / nm_total::DOUBLE, 6) AS both_visible_rate, round(nm_at_least_one_visible / nm_total::DOUBLE, 6) AS at_least_one_visible_rate, round(nm_ego_relevant_aware / nm_ego_relevant::DOUBLE, 6) AS ego_relevant_awareness_rate, 1.0::DOUBLE AS cooperative_rate FROM (SELECT sum(nm_total)::BIGINT AS nm_total, sum(nm_both_visible)::BIGINT AS nm_both_visible, sum(nm_at_least_one_visible)::BIGINT AS nm_at_least_one_visible, sum(nm_ego_relevant)::BIGINT AS nm_ego_relevant, sum(nm_ego_relevant_aware)::BIGINT AS nm_ego_relevant_aware FROM m) AS q", *GRID120, nm_cte("s", "m")),
    "sweep_summary": query(f"SELECT frames, n_obs, {r(*MEAN_NAMES, 'nearby_total', 'nearby_visible')} FROM (SELECT count(DISTINCT frame_idx) AS frames, count(*) AS n_obs, {MEANS}, avg(n_nearby_total) AS nearby_total, avg(n_nearby_visible) AS nearby_visible FROM o) AS q", *OBS),
    "sweep_by_approach": query(f"SELECT approach, n_obs, {r('mean_visibility', 'median_visibility', 'std_visibility', 'mean_nearby_visibility')} FROM (SELECT approach, count(*) AS n_obs, avg(visibility_ratio_onboard) AS mean_visibility, median(visibility_ratio_onboard) AS median_visibility, stddev_samp(visibility_ratio_onboard) AS std_visibility, avg(nearby_visibility_ratio) AS mean_nearby_visibility FROM o JOIN egos USING (ego_id) GROUP BY 1) AS q", *OBS),
    "fov_range_sensitivity": query(f"SELECT fov_deg, range_m, {r('visibility_mean', 'visibility_median', 'cooperative_benefit', 'nm_detectability_onboard', 'nm_detectability_cooperative', *(f'vis_{a}' for a in c.APPROACHES))} FROM sens", *SENS, SENS_TABLE),
    "fov_range_pivot": query("SELECT fov_deg, " + ", ".join(f"round(max(visibility_mean) FILTER (range_m = {x}), 6) AS r{x:g}" for x in c.SENSITIVITY_RANGES) + " FROM sens GROUP BY 1", *SENS, SENS_TABLE),
    "range_sensitivity": query(f"SELECT fov_deg, range_m, {r('int_wide', 'nearby', 'conflict', 'total')} FROM ranges", *RANGE, RANGE_TABLE),
    "range_series": query("SELECT range_m, round(int_wide, 6) AS value FROM ranges WHERE fov_deg = 360", *RANGE, RANGE_TABLE),
    "fov_slice": query("SELECT fov_deg, round(visibility_mean, 6) AS visibility FROM sens WHERE range_m = 35 UNION ALL SELECT 360.0::DOUBLE, (SELECT round(avg(visibility_ratio_onboard), 6) FROM wide)", *SENS, SENS_TABLE, egos_cte(15, "egos2"), vis_ctes(360.0, "w", "egos2"), seen_cte("w", "ws"), obs_cte("ws", "wide")),
    "vehicle_ego_yaw": query(f"SELECT {VEH_COLS} FROM veh", *vehicle_ctes("yaw")),
    "vehicle_ego_inward": query(f"SELECT {VEH_COLS} FROM veh", *vehicle_ctes("inward")),
    "vehicle_ego_region_summary": query(f"SELECT subset, n_obs, frames, {r(*MEAN_NAMES)}, round(n_obs / greatest(frames, 1)::DOUBLE, 6) AS mean_ego_per_frame FROM vsum", *vehicle_ctes("yaw")),
    "inbound_share": query("SELECT round(avg(CASE WHEN ego_inbound THEN 1.0 ELSE 0.0 END), 6) AS inbound_share FROM vegos WHERE ego_dist_to_center <= 28.0", vehicles_cte("yaw")),
    "design_comparison": query(f"SELECT 'grid' AS design, count(*) AS n_obs, {', '.join(f'round(avg({x}), 6) AS {n}' for n, x in (('int_wide', 'visibility_ratio_onboard'), ('nearby', 'nearby_visibility_ratio'), ('conflict', 'conflict_zone_visibility_ratio'), ('occluded', 'n_occluded'), ('out_fov', 'n_out_of_fov'), ('out_range', 'n_out_of_range'), ('total', 'n_objects_total')))} FROM og UNION ALL SELECT 'vehicle_' || subset, n_obs, {r('int_wide', 'nearby', 'conflict', 'occluded', 'out_fov', 'out_range', 'total')} FROM vsum", egos_cte(), vis_ctes(120.0, "vg"), seen_cte("vg", "sg"), obs_cte("sg", "og"), *vehicle_ctes("yaw")),
    "partner_perspectives": query("SELECT * FROM persp", PERSPECTIVES),
    "partner_ttc_rows": query(f"SELECT frame_idx, ego_track_id, partner_id, fov_deg, visible, reason, {r('partner_range', 'partner_bearing_abs_deg')} FROM rows", *TTC),
    "partner_closest": query("SELECT fov_deg, a, b, closest FROM pairs", *TTC, PAIRS),
    "partner_ever_visible": query("SELECT fov_deg, a, b, ever FROM pairs", *TTC, PAIRS),
    "reason_breakdown": query(f"SELECT fov_deg, {r(*(f'share_{x}' for x in c.REASONS))} FROM (SELECT fov_deg, {SHARES} FROM rows GROUP BY 1) AS q", *TTC),
    "pet_candidates": query("SELECT * FROM cand", CANDIDATES),
    "pet_crossings": query(f"SELECT ego_track_id, partner_id, {r('crossing_m')}, ego_frame, partner_frame, {r('pet_s')} FROM crossing", CANDIDATES, CROSSINGS),
    "pet_conflicts": query(f"SELECT ego_track_id, partner_id, partner_class, {r('pet_s', 'min_sep_m')}, frame_idx FROM conflict", *PET),
    "pet_summary": query(f"SELECT fov_deg, n_conflict_pairs, {r('partner_visible_rate', *(f'share_{x}' for x in c.REASONS), 'median_pet_s', 'median_min_sep_m')} FROM (SELECT fov_deg, count(*) AS n_conflict_pairs, avg(visible::INT) AS partner_visible_rate, {SHARES}, median(pet_s) AS median_pet_s, median(min_sep_m) AS median_min_sep_m FROM rows GROUP BY 1) AS q", *PET, *partner_ctes("conflict", ", w.pet_s, w.min_sep_m")),
    "nearest_vehicle": query(f"SELECT frame_idx, ego_id::BIGINT AS ego_id, {r('d_sensor', 'd_center')} FROM near", *OBS, NEAREST),
    "proximity_bins": query(f"SELECT bin_m, count(*) AS n_obs, round(100.0 * count(*) / (SELECT count(*) FROM near), 6) AS pct_obs, round(avg(visibility_ratio_onboard), 6) AS mean_visibility, round(avg(n_occluded), 6) AS mean_occluded, round(avg(n_out_of_fov), 6) AS mean_out_of_fov, round(avg(n_objects_total), 6) AS mean_total_obj FROM (SELECT *, CASE {BIN} END AS bin_m FROM near) AS q WHERE bin_m IS NOT NULL GROUP BY 1", *OBS, NEAREST),
    "clearance_correction": query("SELECT clearance_m, n_kept, round(pct_dropped, 6) AS pct_dropped, round(v, 6) AS int_wide_visibility, round(v - max(v) FILTER (clearance_m = 0) OVER (), 6) AS delta FROM (SELECT clearance_m, count(*) FILTER (d_center >= clearance_m OR d_center IS NULL) AS n_kept, 100.0 * (1 - count(*) FILTER (d_center >= clearance_m OR d_center IS NULL) / count(*)::DOUBLE) AS pct_dropped, avg(visibility_ratio_onboard) FILTER (d_center >= clearance_m OR d_center IS NULL) AS v FROM near CROSS JOIN (VALUES (0.0::DOUBLE), " + ", ".join(f"({x}::DOUBLE)" for x in c.CLEARANCES) + ") AS k(clearance_m) GROUP BY 1) AS q", *OBS, NEAREST),
    "vertical_visibility": query(f"SELECT coalesce(upper(substr(class_name, 1, 1)) || substr(class_name, 2), 'Overall') AS scope, count(*) AS n, round(avg(visible::INT), 6) AS planar, round(avg((visible OR {CLEARS.format(h=1.8)})::INT), 6) AS vertical FROM s GROUP BY ROLLUP (class_name)", *GRID120),
    "sensor_height_curve": query(f"SELECT hs AS sensor_height_m, round(avg((visible OR {CLEARS.format(h='hs')})::INT), 6) AS visibility FROM s CROSS JOIN (VALUES {', '.join(f'({x}::DOUBLE)' for x in c.SENSOR_HEIGHTS)}) AS k(hs) GROUP BY 1", *GRID120),
    "confidence_ungated": query("SELECT count(*) AS n, round(avg(v120::INT), 6) AS fov_120, round(avg(v360::INT), 6) AS fov_360 FROM views", *VIEWS),
    "confidence_curve": query(f"SELECT tau, round(avg((v120 AND score >= tau)::INT), 6) AS fov_120, round(avg((v360 AND score >= tau)::INT), 6) AS fov_360, round(avg((score >= tau)::INT), 6) AS v2i FROM views CROSS JOIN (VALUES {TAUS}) AS k(tau) GROUP BY 1", *VIEWS),
    "confidence_grid": query(f"SELECT tau_av, tau_rsu, round(avg(((v360 AND score >= tau_av) OR score >= tau_rsu)::INT), 6) AS cooperative FROM views CROSS JOIN (VALUES {TAUS}) AS k(tau_av) CROSS JOIN (VALUES {TAUS}) AS l(tau_rsu) GROUP BY 1, 2", *VIEWS),
    "occlusion_shadow": query("SELECT blocker_class AS occluder_class, count(*) AS n_occluders, sum(hidden)::BIGINT AS n_hidden, round(avg(hidden), 6) AS shadow FROM (SELECT frame_idx, ego_id, occluded_by, blocker_class, count(*) AS hidden FROM s WHERE reason = 'occluded' GROUP BY 1, 2, 3, 4) AS q GROUP BY 1", *GRID120),
    "truck_occlusion_share": query("SELECT count(*) FILTER (blocker_class = 'truck') AS by_truck, count(*) FILTER (blocker_class IN ('car', 'truck')) AS by_all, round(count(*) FILTER (blocker_class = 'truck') / count(*) FILTER (blocker_class IN ('car', 'truck'))::DOUBLE, 6) AS truck_share FROM s", *GRID120),
    "lead_vehicle_benefit": query("SELECT lead_class, n, round(visibility, 6) AS visibility, round(mv, 6) AS mean_visible, round(mh, 6) AS mean_hidden_by_trucks, round(mt, 6) AS mean_total, round(n / (SELECT count(*) FROM leads)::DOUBLE, 6) AS probability, round(greatest(mt - mv - mh, 0.0), 6) AS mean_other_hidden FROM (SELECT lead_class, count(*) AS n, avg(seen / total::DOUBLE) AS visibility, avg(seen) AS mv, avg(hidden) AS mh, avg(total) AS mt FROM leads WHERE lead_class IS NOT NULL GROUP BY 1) AS q", *GRID120, LEADS),
    "track_speeds": query(f"SELECT track_id, frame_idx, {r('speed_mps')} FROM speeds", SPEEDS),
    "speed_summary": query("SELECT class_name, round(avg(speed_mps), 6) AS mean, round(median(speed_mps), 6) AS median, round(stddev_samp(speed_mps), 6) AS std, round(quantile_cont(speed_mps, 0.05), 6) AS p05, round(quantile_cont(speed_mps, 0.95), 6) AS p95 FROM speeds WHERE speed_mps IS NOT NULL GROUP BY 1", SPEEDS),
    "dimension_summary": query("SELECT class_name, dimension, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS std FROM (SELECT class_name, 'bbox_dx' AS dimension, bbox_dx AS value FROM tracks UNION ALL SELECT class_name, 'bbox_dy', bbox_dy FROM tracks UNION ALL SELECT class_name, 'bbox_dz', bbox_dz FROM tracks) AS q GROUP BY 1, 2"),
    "class_summary": query("SELECT class_name, count(*) AS n_rows, count(DISTINCT track_id) AS n_tracks FROM tracks GROUP BY 1"),
    "track_length_stats": query("SELECT class_name, round(avg(n), 6) AS mean, round(median(n), 6) AS median, round(stddev_samp(n), 6) AS std, min(n) AS min, max(n) AS max FROM (SELECT class_name, track_id, count(*) AS n FROM tracks GROUP BY 1, 2) AS q GROUP BY 1"),
    "arrival_rates": query("SELECT class_name, n_tracks, total_frames, round(m, 6) AS duration_minutes, round(n_tracks / m, 6) AS tracks_per_minute, round(sum(round(n_tracks / m, 2)) OVER (), 6) AS total_tracks_per_minute FROM (SELECT class_name, count(DISTINCT track_id) AS n_tracks, (SELECT count(DISTINCT frame_idx) FROM tracks) AS total_frames, (SELECT count(DISTINCT frame_idx) FROM tracks) * 0.1::DOUBLE / 60.0 AS m FROM tracks GROUP BY 1) AS q"),
    "frame_bounds": query("SELECT min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, count(DISTINCT frame_idx) AS n_frames FROM tracks"),
    "near_miss_pair_types": query("SELECT concat_ws('-', least(class_a, class_b), greatest(class_a, class_b)) AS pair_type, count(*) AS n FROM nm GROUP BY 1"),
    "ttc_stats": query("SELECT count(ttc) AS count, round(avg(ttc), 6) AS mean, round(median(ttc), 6) AS median, round(stddev_samp(ttc), 6) AS std, round(min(ttc), 6) AS min, round(quantile_cont(ttc, 0.05), 6) AS p05, round(quantile_cont(ttc, 0.95), 6) AS p95 FROM nm"),
    "separation_stats": query("SELECT count(min_separation) AS count, round(avg(min_separation), 6) AS mean, round(median(min_separation), 6) AS median, round(stddev_samp(min_separation), 6) AS std, round(min(min_separation), 6) AS min FROM nm"),
    "following_episodes": query(f"SELECT track_id, first_frame, n_frames, {r('seconds')} FROM runs", FOLLOWING),
    "following_stats": query("SELECT count(*) AS n, round(avg(seconds), 6) AS mean, round(median(seconds), 6) AS median, round(quantile_cont(seconds, 0.9), 6) AS p90, round(max(seconds), 6) AS max, round(avg((n_frames >= 20)::INT), 6) AS share_2s, round(avg((n_frames >= 50)::INT), 6) AS share_5s FROM runs", FOLLOWING),
    "object_decomposition": query("SELECT fov_deg, round(avg(n_visible_onboard), 6) AS visible, round(avg(n_occluded), 6) AS occluded, round(avg(n_out_of_fov), 6) AS out_fov, round(avg(n_out_of_range), 6) AS out_range FROM o GROUP BY 1", *BOTH, obs_cte("s", "o")),
}
for _fov in (120, 360):
    ORACLES[f"partner_ttc_summary_{_fov}"] = query(
        f"SELECT n_event_frames, n_unique_pairs, {r('partner_visible_rate', *(f'share_{x}' for x in c.REASONS), 'median_partner_range_m', 'median_partner_bearing_deg', 'frac_partner_outside_120fov', 'frac_partner_behind_ego')}, (SELECT round(avg(closest::INT), 6) FROM pairs WHERE fov_deg = {_fov}) AS partner_visible_at_closest_frame, (SELECT round(avg(ever::INT), 6) FROM pairs WHERE fov_deg = {_fov}) AS partner_visible_ever_in_event FROM (SELECT count(*) AS n_event_frames, (SELECT count(*) FROM pairs WHERE fov_deg = {_fov}) AS n_unique_pairs, avg(visible::INT) AS partner_visible_rate, {SHARES}, median(partner_range) AS median_partner_range_m, median(partner_bearing_abs_deg) AS median_partner_bearing_deg, avg((partner_bearing_abs_deg > 60)::INT) AS frac_partner_outside_120fov, avg((partner_bearing_abs_deg > 120)::INT) AS frac_partner_behind_ego FROM rows WHERE fov_deg = {_fov}) AS q",
        *TTC,
        PAIRS,
    )
CLASS_JSON = "json AS (SELECT frame_idx, ego_id, '{' || string_agg('\"' || class_name || '\":{\"visible\":' || n_visible || ',\"total\":' || n_total || '}', ',' ORDER BY class_name) || '}' AS class_visibility FROM (SELECT frame_idx, ego_id, class_name, count(*) FILTER (visible) AS n_visible, count(*) AS n_total FROM s GROUP BY 1, 2, 3) AS q GROUP BY 1, 2)"
ORACLES["class_visibility_json"] = query("SELECT frame_idx, ego_id::BIGINT AS ego_id, class_visibility FROM json", *GRID120, CLASS_JSON)
_RECORD_COUNTS = "n_nearby_total, n_nearby_visible, n_conflict_zone_total, n_conflict_zone_visible"
_RECORD_NM = ", ".join(f"coalesce(m.{n}, 0) AS {n}" for n in ("nm_total", "nm_both_visible", "nm_at_least_one_visible", "nm_ego_relevant", "nm_ego_relevant_aware"))
ORACLES["sweep_record"] = query(
    f"""SELECT o.frame_idx, e.approach, e.pos::BIGINT AS pos, o.fov_deg, o.range_m, {r('ego_x', 'ego_y')}, round(degrees(ego_h), 6) AS ego_heading_deg, {OBS_COUNTS}, {_RECORD_COUNTS},
        {r('visibility_ratio_onboard', 'nearby_visibility_ratio', 'conflict_zone_visibility_ratio')}, 1.0::DOUBLE AS visibility_ratio_cooperative, {_RECORD_NM},
        coalesce(m.nm_both_visible, 0) AS nm_detectable_onboard, coalesce(m.nm_total, 0) AS nm_detectable_cooperative, json.class_visibility
        FROM o JOIN egos AS e USING (ego_id) JOIN json USING (frame_idx, ego_id) LEFT JOIN m USING (frame_idx, ego_id) ORDER BY o.frame_idx, e.approach, e.pos""",
    *OBS, nm_cte("s", "m"), CLASS_JSON,
)
ORACLES["confidence_joined"] = query(
    "SELECT t.frame_idx, e.ego_id::BIGINT AS ego_id, t.track_id, round(t.score, 6) AS score, coalesce(v.v120, FALSE) AS v120, coalesce(v.v360, FALSE) AS v360 FROM tracks AS t CROSS JOIN egos AS e LEFT JOIN (SELECT frame_idx, ego_id, track_id, bool_or(fov_deg = 120) AS v120, bool_or(fov_deg = 360) AS v360 FROM s WHERE visible GROUP BY 1, 2, 3) AS v USING (frame_idx, ego_id, track_id)",
    *BOTH,
)
ORACLES["near_miss_figure"] = query(
    f"""SELECT 'a' AS panel, 'fov_' || fov_deg::INT AS bar, 'visible' AS part, 0.0::DOUBLE AS bottom, round(avg(visible::INT), 6) AS height FROM rows GROUP BY fov_deg
        UNION ALL SELECT 'a', 'cooperative', 'visible', 0.0, 1.0
        UNION ALL SELECT 'b', bar, part, round(bottom, 6), round(height, 6) FROM (
            SELECT 'fov_' || fov_deg::INT AS bar, part, height, coalesce(sum(height) OVER (PARTITION BY fov_deg ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS bottom FROM (
                SELECT fov_deg, place, part, avg(CASE WHEN reason = part THEN 1.0 ELSE 0.0 END) AS height FROM rows CROSS JOIN (VALUES {", ".join(f"({i}, '{x}')" for i, x in enumerate(c.REASONS))}) AS p(place, part) GROUP BY 1, 2, 3) AS q) AS z""",
    *TTC,
)
ORACLES["vertical_list"] = query(
    f"SELECT frame_idx, ego_id::BIGINT AS ego_id, track_id // 2 AS track_id, {r('x', 'y', 'rng')}, reason, CASE WHEN blocked THEN round(bnear, 6) END AS blocker_near, CASE WHEN blocked THEN round(ch, 6) END AS blocker_height FROM s",
    # rows get numbers of their own, in the order of tracks, and rows of one track at one range do not meet in this scene
    f"listed AS ({REPEATED}), numbered AS (SELECT * REPLACE (track_id * 2 + row_number() OVER (PARTITION BY frame_idx, track_id ORDER BY bbox_center_x) - 1 AS track_id) FROM listed)",
    egos_cte(), vis_ctes(120.0, "v", scene="numbered"), seen_cte("v", "s"),
)
ORACLES["verified_export"] = """
SELECT lang, part, strlen(body)::BIGINT AS size, md5(body) AS md5, TRUE AS verified
FROM (SELECT coalesce(lang, '-') AS lang, doc_id // 1000 AS part, string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id) AS body FROM documents GROUP BY 1, 2) AS files"""
ORACLES["stored_frames"] = ORACLES["observation_counts"]
ORACLES["ordered_record"] = query("SELECT approach, count(*) AS n_obs, sum(n_visible_onboard)::BIGINT AS n_visible, TRUE AS in_order FROM o JOIN egos USING (ego_id) GROUP BY 1", *OBS)
_TRACK = f"frame_idx, track_id, class_name, {r('bbox_center_x', 'bbox_center_y', 'bbox_dx', 'bbox_dy', 'bbox_dz', 'bbox_yaw', 'score')}"
ORACLES |= {
    "tracks_read": query(f"SELECT {_TRACK} FROM tracks"),
    "tracks_projected": query("SELECT frame_idx, track_id, class_name FROM tracks"),
    "near_misses_read": query(f"SELECT frame_idx, track_id_a, track_id_b, class_a, class_b, {r('ttc', 'min_separation')} FROM nm"),
    "record_read": query(f"SELECT approach, {r('ego_x', 'ego_y')}, count(*) AS n_obs, sum(n_occluded)::BIGINT AS n_occluded, sum(coalesce(m.nm_ego_relevant, 0))::BIGINT AS nm_ego_relevant, 0::BIGINT AS n_class_maps FROM o JOIN egos USING (ego_id) LEFT JOIN m USING (frame_idx, ego_id) GROUP BY approach, ego_x, ego_y", *OBS, nm_cte("s", "m")),
    "rows_json": ORACLES["class_summary"],
    "document_json": query("SELECT max(frame_idx)::VARCHAR AS record_bounds_last_frame, count(DISTINCT frame_idx)::VARCHAR AS record_bounds_n_frames, 'tracks' AS kind, NULL::VARCHAR AS record_none FROM tracks"),
    "first_frames": query("SELECT frame_idx FROM (SELECT DISTINCT frame_idx FROM scene) AS f ORDER BY frame_idx LIMIT 20", strided_cte(5)),
    # as for the list form; then a track's farthest rows
    "repeated_farthest": query(
        f"SELECT frame_idx, ego_id::BIGINT AS ego_id, track_id // 2 AS track_id, {r('rng')}, reason, occluded_by // 2 AS occluded_by FROM (SELECT *, max(rng) OVER (PARTITION BY frame_idx, ego_id, track_id // 2) AS farthest FROM s) AS q WHERE rng = farthest",
        f"listed AS ({REPEATED}), numbered AS (SELECT * REPLACE (track_id * 2 + row_number() OVER (PARTITION BY frame_idx, track_id ORDER BY bbox_center_x) - 1 AS track_id) FROM listed)",
        egos_cte(), vis_ctes(120.0, "v", scene="numbered"), seen_cte("v", "s"),
    ),
    "object_spans": query(
        "SELECT frame_idx, ego_id::BIGINT AS ego_id, track_id, round(a[i % 4 + 1], 6) AS start, round(a[i], 6) AS stop FROM k", *GRID120[:2],
        "a AS (SELECT frame_idx, ego_id, track_id, list_sort([rel0, rel1, rel2, rel3]) AS a FROM v_g)",
        f"k AS (SELECT *, list_position(gaps, list_max(gaps)) AS i FROM (SELECT *, [a[2] - a[1], a[3] - a[2], a[4] - a[3], a[1] + {TWO_PI} - a[4]] AS gaps FROM a) AS q)",
    ),
}
