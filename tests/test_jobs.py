import hashlib
import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import manifest, observe
from jobs.common import config_of
from sightline.plans import fixture

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent
SMALL = {"slab_frames": 10, "fovs": [120.0], "range_m": 35.0, "positions": 2}


def files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in Path(folder).rglob("part-*")}


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_observations_of_growing_events(spark, tmp_path):
    events, out = str(tmp_path / "events"), str(tmp_path / "out")
    table = spark.read.parquet(f"{SF}/events.parquet")
    settings = {k: spark.conf.get(k, None) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.requireAllClusterKeysForCoPartition")}
    table.where("event_id < 300").coalesce(1).write.parquet(events)  # 25 frames: two whole slabs and half of one
    first = observe.run(spark, out, events=events, config=SMALL)
    assert first == {"read": 300, "slabs": 3, "written": 25 * 8}
    before = files(f"{out}/records")
    assert observe.run(spark, out, events=events, config=SMALL) == {"read": 60, "slabs": 0, "written": 0} and files(f"{out}/records") == before
    table.where("event_id BETWEEN 300 AND 503").coalesce(1).write.mode("append").parquet(events)  # up to frame 41
    second = observe.run(spark, out, events=events, config=SMALL)
    assert second == {"read": 264, "slabs": 3, "written": 22 * 8}
    after = files(f"{out}/records")
    assert {k for k in before if k in after} == {k for k in before if "slab=0/" in k or "slab=1/" in k}
    assert all(after[k] == before[k] for k in before if k in after)
    observe.run(spark, str(tmp_path / "once"), events=events, config=SMALL)
    assert rows(observe.records(spark, out)) == rows(observe.records(spark, str(tmp_path / "once")))
    assert settings == {k: spark.conf.get(k, None) for k in settings}


def test_a_run_that_died_and_slabs_made_anew(spark, tmp_path):
    """Records without a mark are written again; late rows of a final slab come in with since."""
    tracks = fixture.tracks(spark, SF)
    tracks.where("frame_idx < 30 AND NOT (frame_idx = 5 AND track_id = 3)").write.parquet(str(tmp_path / "tracks"))
    fixture.near_misses(spark, tracks.where("frame_idx < 30")).write.parquet(str(tmp_path / "near"))
    paths = {"tracks": str(tmp_path / "tracks"), "near_misses": str(tmp_path / "near"), "config": SMALL}
    out = str(tmp_path / "out")
    observe.run(spark, out, **paths)
    want = rows(observe.records(spark, out))
    for p in (tmp_path / "out" / "mark").iterdir():
        p.unlink()
    observe.run(spark, out, **paths)
    assert rows(observe.records(spark, out)) == want
    tracks.where("frame_idx = 5 AND track_id = 3").write.mode("append").parquet(str(tmp_path / "tracks"))
    assert observe.run(spark, out, **paths)["slabs"] == 0
    assert observe.run(spark, out, **paths, since=0)["slabs"] == 3
    seen = observe.records(spark, out).where("frame_idx = 5").agg(F.min("n_objects_total"), F.max("n_objects_total")).first()
    assert seen[:] == (12, 12)


def test_record_files_are_in_order(spark, tmp_path):
    """Each slab is one file in order, so that row groups of other frames are passed over."""
    import pyarrow.parquet as pq

    out = tmp_path / "out"
    observe.run(spark, str(out), events=f"{SF}/events.parquet", config=SMALL)
    for slab in (out / "records").glob("slab=*"):
        (file,) = slab.glob("part-*")
        keys = [(r["frame_idx"], r["approach"], r["pos"]) for r in pq.ParquetFile(file).read(["frame_idx", "approach", "pos"]).to_pylist()]
        assert keys == sorted(keys) and {k[0] // 10 for k in keys} == {int(slab.name.split("=")[1])}


def brute_manifest(texts):
    out = {}
    for source in {s for _, _, s in texts}:
        own = [(i, t) for i, t, s in texts if s == source]
        md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
        named = [md5(("" if i is None else str(i)) + ("-" if t is None else "+" + t)) for i, t in own]
        total = ":".join(map(str, (len(own), sum(int(h[:15], 16) for h in named), sum(int(h[15:30], 16) for h in named))))
        out[source] = (len(own), sum(t is None for _, t in own), sum(len((t or "").encode()) for _, t in own), len({t or "" for _, t in own}), md5(total))
    return out


def test_manifest_of_growing_texts(spark, tmp_path):
    texts, out, state = (str(tmp_path / n) for n in ("texts", "out", "state"))
    schema = "doc_id long, text string, source string, part string, batch long"
    old = [(1, "a", "x", "p", 0), (2, "a", "x", "p", 0), (3, None, "x", "p", 0), (4, "", "y", "p", 0), (None, "é" * 70_000, None, "p", 0), (5, "b", "", "p", 0), (5, "b", "", "p", 0)]
    new = [(6, "c", "y", "p", 1), (4, "", "y", "p", 1), (7, "d", "z", "p", 1)]
    config = config_of("manifest") | {"files_per_batch": 1}
    spark.createDataFrame(old, schema).repartition(3).write.parquet(texts)
    got = lambda: {r.source: (r.n_records, r.n_missing, r.n_bytes, r.distinct_texts, r.digest) for r in manifest.manifest(spark, out).collect()}
    report = manifest.run(spark, texts, out, state, config)
    assert report["read"] == len(old) and got() == brute_manifest([r[:3] for r in old])
    before, kept = files(out), files(f"{state}/records")
    assert manifest.run(spark, texts, out, state, config) == {"read": 0, "records": len(old), "parts": 0} and files(out) == before
    manifest.manifest(spark, out).write.parquet(str(tmp_path / "earlier"))
    spark.createDataFrame(new, schema).coalesce(1).write.mode("append").parquet(texts)
    report = manifest.run(spark, texts, out, state, config, expected=str(tmp_path / "earlier"))
    assert report["read"] == len(new) and report["parts"] == 2 and report["different"] == ["+y"]
    assert got() == brute_manifest([r[:3] for r in old + new])
    assert all(files(f"{state}/records")[k] == t for k, t in kept.items()) and sum(files(out).get(k) == t for k, t in before.items()) == len(before) - 1
    # the same records in other files have the same digests
    spark.createDataFrame(new + old, schema).repartition(5, "text").write.parquet(str(tmp_path / "again"))
    manifest.run(spark, str(tmp_path / "again"), str(tmp_path / "out2"), str(tmp_path / "state2"), config)
    assert {r.source: r.digest for r in manifest.manifest(spark, str(tmp_path / "out2")).collect()} == {k: v[-1] for k, v in got().items()}


def test_a_batch_that_was_not_finished_and_a_lost_manifest(spark, tmp_path):
    """Records of a batch that the checkpoint does not know are overwritten; a lost output is made from the records."""
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    manifest.run(spark, f"{SF}/documents.parquet", out, state)
    want = rows(manifest.manifest(spark, out))
    for commit in (tmp_path / "state" / "stream" / "commits").iterdir():
        commit.unlink()
    for p in Path(out).rglob("part-*"):
        p.unlink()
    assert manifest.run(spark, f"{SF}/documents.parquet", out, state)["records"] == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert rows(manifest.manifest(spark, out)) == want


@pytest.mark.parametrize("job, more", [("observe", ["--events", f"{SF}/events.parquet"]), ("manifest", ["--texts", f"{SF}/documents.parquet", "--checkpoint", "{tmp}/state"])])
def test_command_lines(spark, tmp_path, job, more):
    config = tmp_path / "config.json"
    config.write_text(json.dumps(SMALL if job == "observe" else config_of("manifest")))
    said = subprocess.run([sys.executable, "-m", f"jobs.{job}", "--out", str(tmp_path / "out"), "--config", str(config), *(x.format(tmp=tmp_path) for x in more)], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert said.returncode == 0 and f"jobs.{job}" in said.stderr and "wrote" in said.stderr
    made = observe.records(spark, str(tmp_path / "out")) if job == "observe" else manifest.manifest(spark, str(tmp_path / "out"))
    assert made.count() == (84 * 8 if job == "observe" else spark.read.parquet(f"{SF}/documents.parquet").select("source").distinct().count())
