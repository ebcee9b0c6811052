"""Entry script: `python -m sightline <analysis> --tracks <parquet> [...] --out <folder>`.

Each analysis reads Parquet, writes its tables and summaries below the output folder, and prints its summary.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import config as c
from .operators import conflicts, egos, frames, observe, proximity, summary, trajectory, whatif
from .operators import visibility as vis
from .sources import digests, results, sinks, tables
from .sources.shared import written


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="sightline", description="What sensors can and cannot observe in scenes of tracked road users.")
    kinds = out.add_subparsers(dest="analysis", required=True)

    def add(name: str, text: str, near: bool = False, tracks: bool = True) -> argparse.ArgumentParser:
        p = kinds.add_parser(name, help=text)
        if tracks:
            p.add_argument("--tracks", required=True, help="Parquet of tracked objects")
        if near:
            p.add_argument("--near-misses", required=True, help="Parquet of near misses")
        p.add_argument("--out", required=True, help="output folder")
        return p

    def windowed(p: argparse.ArgumentParser, step: int, positions: int) -> None:
        p.add_argument("--frame-start", type=int, default=0)
        p.add_argument("--frame-end", type=int, default=0)
        p.add_argument("--frame-step", type=int, default=step)
        p.add_argument("--max-frames", type=int, default=0)
        p.add_argument("--n-ego-per-approach", type=int, default=positions)

    p = add("sweep", "every observation from a grid of egos", near=True)
    p.add_argument("--fov-deg", type=float, default=c.SENSOR["fov_deg"])
    p.add_argument("--range-m", type=float, default=c.SENSOR["range_m"])
    windowed(p, c.FRAME_STEP["canonical"], 15)
    windowed(add("sensitivity", "fields of view by ranges", near=True), c.FRAME_STEP["sensitivity"], c.SENSITIVITY_POSITIONS)
    windowed(add("ranges", "a series of ranges at two fields of view", near=True), c.FRAME_STEP["range"], 15)
    p = add("near-misses", "whether parties of a near miss see each other", near=True)
    p.add_argument("--heading-mode", choices=["yaw", "inward"], default="yaw")
    p.add_argument("--with-pet", action="store_true")
    p.add_argument("--pet-thresh-s", type=float, default=5.0)
    p.add_argument("--pet-cross-m", type=float, default=2.0)
    p = add("vehicles", "every detected vehicle as the ego")
    p.add_argument("--fov-deg", type=float, default=c.SENSOR["fov_deg"])
    p.add_argument("--range-m", type=float, default=c.SENSOR["range_m"])
    p.add_argument("--region-radius-m", type=float, default=c.REGION_M)
    p.add_argument("--baseline", help="JSON of a grid's totals by field of view, to stand beside the vehicles")
    p.add_argument("--baseline-poses", type=int, default=60, help="poses of that grid in a frame")
    p.add_argument("--heading-mode", choices=["yaw", "inward"], default="yaw")
    add("proximity", "bias from egos near real vehicles, from a sweep's records").add_argument("--records", required=True)
    add("traffic", "statistics of trajectories and near misses", near=True).add_argument("--dt", type=float, default=c.FRAME_S)
    p = add("occlusion", "planar and vertical visibility")
    p.add_argument("--fovs", type=float, nargs="+", default=[120.0, 360.0])
    p.add_argument("--n-frames", type=int, default=c.SAMPLE_FRAMES)
    p.add_argument("--sensor-h", type=float, default=c.SENSOR_HEIGHT_M)
    add("confidence", "what a limit of detection confidence costs").add_argument("--n-frames", type=int, default=c.SAMPLE_FRAMES)
    add("passing", "what a lead vehicle hides").add_argument("--n-frames", type=int, default=c.SAMPLE_FRAMES)
    p = add("verify", "files of a folder held against a manifest of digests", tracks=False)
    p.add_argument("--folder", required=True)
    p.add_argument("--manifest", required=True, help="JSON array of name and md5")
    p.add_argument("--ledger", help="folder that remembers verified files, which are not read again")
    p.add_argument("--force", action="store_true", help="read them all the same")
    p.add_argument("--remove", action="store_true", help="delete files whose digest differs")
    p = add("following", "episodes of cars behind trucks")
    p.add_argument("--lead-range", type=float, default=15.0)
    p.add_argument("--cone-deg", type=float, default=30.0)
    p.add_argument("--hz", type=float, default=10.0)
    return out


def _chosen(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    rows = tables.read_tracks(spark, a.tracks)
    return frames.of_frames(rows, frames.strided(rows, a.frame_step, a.max_frames, a.frame_start, a.frame_end))


def _sampled(spark: SparkSession, a: argparse.Namespace, fovs: Sequence[float]) -> DataFrame:
    rows = tables.read_tracks(spark, a.tracks)
    rows = frames.of_frames(rows, frames.evenly(rows, a.n_frames)) if a.n_frames else rows
    return vis.classified(vis.visibility(rows, egos.grid(spark), fovs))


def _records(spark: SparkSession, a: argparse.Namespace, fovs: Sequence[float], ranges: Sequence[float], classes: bool = False, in_order: bool = False) -> DataFrame:
    return observe.sweep(_chosen(spark, a), tables.read_near_misses(spark, a.near_misses), egos.grid(spark, positions=a.n_ego_per_approach), fovs, ranges, classes=classes, in_order=in_order)


def _by(df: DataFrame, key: str) -> dict:
    return {str(r.pop(key)): r for r in sinks.document(df.orderBy(key))}


def sweep(spark: SparkSession, a: argparse.Namespace) -> dict:
    record = _records(spark, a, [a.fov_deg], [a.range_m], classes=True, in_order=True).withColumn("class_visibility", observe.class_json(F.col("class_visibility")))
    sinks.write_ordered(record.select(*(f.name for f in results.RECORD)), f"{a.out}/ego_sweep_results.parquet", ["frame_idx", "approach", "pos"], dealt=True)
    made = spark.read.parquet(f"{a.out}/ego_sweep_results.parquet")
    (whole,), (near,) = sinks.document(summary.sweep_summary(made)), sinks.document(summary.detectability(made))
    rates = {n: near[n] for n in ("both_visible_rate", "at_least_one_visible_rate", "ego_relevant_awareness_rate")} if near["nm_total"] else {}
    return {"sensor_config": {"fov_deg": a.fov_deg, "range_m": a.range_m, "near_blind_m": c.SENSOR["near_blind_m"]}, "summary": whole, "near_miss_detectability": rates, "by_approach": _by(summary.by_approach(made), "approach")}


def sensitivity(spark: SparkSession, a: argparse.Namespace) -> dict:
    table = summary.sensitivity(_records(spark, a, c.SENSITIVITY_FOVS, c.SENSITIVITY_RANGES)).orderBy("fov_deg", "range_m")
    sinks.write_parquet(table, f"{a.out}/sensitivity_results.parquet", single=True)
    made = results.read_sensitivity(spark, f"{a.out}/sensitivity_results.parquet")
    return {"table": sinks.document(made), "pivot": sinks.document(summary.matrix(made, c.SENSITIVITY_RANGES).orderBy("fov_deg"))}


def ranges(spark: SparkSession, a: argparse.Namespace) -> dict:
    rows = sinks.document(summary.range_sensitivity(_records(spark, a, c.RANGE_FOVS, c.RANGES)).orderBy("fov_deg", "range_m"))
    sinks.write_json(rows, f"{a.out}/range_sensitivity.json")
    return {"table": rows}


def near_misses(spark: SparkSession, a: argparse.Namespace) -> dict:
    scene, near = tables.read_tracks(spark, a.tracks), tables.read_near_misses(spark, a.near_misses)
    fovs = (120.0, 360.0)

    def told(df: DataFrame) -> dict:
        shares = [f"share_{r}" for r in c.REASONS]
        named = df.withColumn("reason_breakdown", F.struct(*(F.col(s).alias(s.removeprefix("share_")) for s in shares))).drop(*shares)
        return {f"fov_{float(k):g}": v for k, v in _by(named, "fov_deg").items()}

    out = {"heading_mode": a.heading_mode, "ttc": told(conflicts.ttc_summary(conflicts.ttc_rows(scene, near, fovs, a.heading_mode)))}
    if a.with_pet:
        found = conflicts.pet_conflicts(scene, a.pet_cross_m, a.pet_thresh_s)
        out["pet"] = told(conflicts.pet_summary(conflicts.pet_rows(scene, found, fovs, a.heading_mode)))
    return out


def vehicles(spark: SparkSession, a: argparse.Namespace) -> dict:
    seen = observe.vehicle_sweep(tables.read_tracks(spark, a.tracks), a.heading_mode, a.fov_deg, a.range_m)
    sinks.write_parquet(seen, f"{a.out}/vehicle_as_ego.parquet")
    subsets = summary.vehicle_summary(spark.read.parquet(f"{a.out}/vehicle_as_ego.parquet"), a.region_radius_m)
    out = {"subsets": sinks.document(subsets.orderBy("subset"))}
    if a.baseline:
        grid = results.read_grid_baseline(spark, a.baseline, a.fov_deg, a.baseline_poses)
        out["comparison"] = sinks.document(summary.design_comparison(grid, subsets, grid["design"]).orderBy("design"))
    return out


def proximity_bias(spark: SparkSession, a: argparse.Namespace) -> dict:
    near = proximity.nearest_vehicle(results.read_records(spark, a.records), tables.read_tracks(spark, a.tracks))
    return {"bins": sinks.document(proximity.bins(near).orderBy("bin_m")), "clearance": sinks.document(proximity.clearance_correction(near).orderBy("clearance_m"))}


def traffic(spark: SparkSession, a: argparse.Namespace) -> dict:
    scene, near = tables.read_tracks(spark, a.tracks), tables.read_near_misses(spark, a.near_misses)
    made = {
        "bounds": trajectory.frame_bounds(scene), "classes": trajectory.class_summary(scene), "speeds": trajectory.speed_summary(trajectory.speeds(scene, a.dt)), "dimensions": trajectory.dimension_summary(scene),
        "lengths": trajectory.track_lengths(scene), "arrivals": trajectory.arrival_rates(scene, a.dt), "pair_types": trajectory.pair_types(near), "ttc": trajectory.ttc_stats(near), "separation": trajectory.separation_stats(near),
    }
    return {k: sinks.document(df) for k, df in made.items()}


def occlusion(spark: SparkSession, a: argparse.Namespace) -> dict:
    out = {}
    for fov in a.fovs:
        seen = _sampled(spark, a, [fov])
        out[f"fov_{fov:g}"] = sinks.document(whatif.vertical(seen, a.sensor_h).orderBy("scope"))
        out[f"heights_{fov:g}"] = sinks.document(whatif.height_curve(seen).orderBy("sensor_height_m"))
    return out


def confidence(spark: SparkSession, a: argparse.Namespace) -> dict:
    views = whatif.scores_of_views(_sampled(spark, a, (120.0, 360.0)))
    return {"ungated": sinks.document(whatif.ungated(views)), "curve": sinks.document(whatif.confidence_curve(views).orderBy("tau")), "grid": sinks.document(whatif.confidence_grid(views).orderBy("tau_av", "tau_rsu"))}


def passing(spark: SparkSession, a: argparse.Namespace) -> dict:
    seen = _sampled(spark, a, (120.0,))
    return {"lead": sinks.document(whatif.lead_benefit(whatif.lead_vehicles(seen))), "shadow": sinks.document(whatif.occlusion_shadow(seen)), "trucks": sinks.document(whatif.truck_share(seen))}


def following(spark: SparkSession, a: argparse.Namespace) -> dict:
    rows = trajectory.following(tables.read_tracks(spark, a.tracks), a.lead_range, a.cone_deg)
    return {"episodes": sinks.document(trajectory.episode_stats(trajectory.episodes(rows, 1.0 / a.hz)))}


def verify(spark: SparkSession, a: argparse.Namespace) -> dict:
    """How many files have which status; the report of each file is a table. Differences and missing files end in an error."""
    manifest = tables.read_rows_json(spark, a.manifest, "name string, md5 string")
    report = written(digests.verify(spark, a.folder, manifest, a.ledger, a.force), "report")
    sinks.write_parquet(report, f"{a.out}/verified_files.parquet")
    if a.ledger:
        digests.remember(report, a.ledger)
    if a.remove:
        digests.drop_mismatches(report).count()
    bad = sinks.document(report.where("status IN ('mismatch', 'missing')").orderBy("name").limit(20).select("name", "status"))
    return {"files": _by(report.groupBy("status").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "status"), "wrong": bad}


ANALYSES = {
    "sweep": sweep, "sensitivity": sensitivity, "ranges": ranges, "near-misses": near_misses, "vehicles": vehicles, "proximity": proximity_bias,
    "traffic": traffic, "occlusion": occlusion, "confidence": confidence, "passing": passing, "following": following, "verify": verify,
}


def told(name: str, value: object) -> list[str]:
    """A summary as tables: lists of rows, dictionaries of rows and single values."""
    if isinstance(value, list):
        return [sinks.table_text(value, name)]
    if isinstance(value, dict) and any(isinstance(v, list | dict) for v in value.values()):
        return [t for k, v in value.items() for t in told(f"{name} {k}".strip(), v)]
    return [sinks.table_text([value], name)] if isinstance(value, dict) and value else [f"{name}: {value}"]


def main(arguments: Sequence[str] | None = None) -> dict:
    a = parser().parse_args(arguments)
    spark = SparkSession.builder.appName(f"sightline {a.analysis}").getOrCreate()
    made = ANALYSES[a.analysis](spark, a)
    sinks.write_json(made, f"{a.out}/{a.analysis}_summary.json")
    print("\n".join(told("", made)))
    if made.get("wrong"):
        raise SystemExit(f"wrong or missing: {', '.join(r['name'] for r in made['wrong'])}")
    return made
