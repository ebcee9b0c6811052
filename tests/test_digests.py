import hashlib
import os
import resource
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from sightline.sources import digests

ROOT = Path(__file__).resolve().parent.parent


def md5(data):
    return hashlib.md5(data).hexdigest()


def folder_of(tmp_path):
    made = {"a.bin": os.urandom(3_000_001), "empty": b"", "deep/er/ä b.txt": "é\n".encode() * 99, "deep/a.bin": b"x"}
    for name, data in made.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    return str(tmp_path / "in"), made


def test_whole_files_and_ranges(spark, tmp_path):
    folder, made = folder_of(tmp_path)
    for given in (folder, f"file://{folder}/"):
        got = {r.name: (r.size, r.md5) for r in digests.digests(digests.files(spark, given), chunk_bytes=4096).collect()}
        assert got == {n: (len(d), md5(d)) for n, d in made.items()}
    ranges = digests.digests(digests.files(spark, folder), range_bytes=1_000_000)
    assert sorted((r.offset, r.length, r.md5) for r in ranges.where("name = 'a.bin'").collect()) == [(i, len(p), md5(p)) for i in range(0, 3_000_001, 1_000_000) for p in [made["a.bin"][i : i + 1_000_000]]]
    one = {r.name: r.md5 for r in digests.range_digest(ranges).collect()}
    assert one == {n: md5("".join(md5(d[i : i + 1_000_000]) for i in range(0, max(len(d), 1), 1_000_000)).encode()) for n, d in made.items()}
    assert {r.name for r in digests.files(spark, folder, "*.bin").collect()} == {"a.bin", "deep/a.bin"} and digests.files(spark, folder + "/none").count() == 0


def test_what_is_known_is_not_read_again(spark, tmp_path):
    folder, made = folder_of(tmp_path)
    rows = [(n, md5(d).upper() if n == "empty" else md5(d)) for n, d in made.items() if n != "deep/a.bin"] + [("gone", "0" * 32)]
    manifest = spark.createDataFrame(rows, "name string, md5 string")
    ledger = str(tmp_path / "ledger")
    status = lambda **k: {r.name: r.status for r in digests.verify(spark, folder, manifest, ledger, **k).collect()}
    first = {"a.bin": "verified", "empty": "verified", "deep/er/ä b.txt": "verified", "gone": "missing", "deep/a.bin": "extra"}
    assert status() == first
    digests.remember(digests.verify(spark, folder, manifest, ledger), ledger)
    again = {k: "known" if v == "verified" and k != "empty" else v for k, v in first.items()}  # an empty file is as soon read as known
    assert status() == again and status(force=True) == first
    # of a known file not a byte is read: with its size and time of change as they were, other bytes pass unseen
    path, then = Path(folder) / "a.bin", os.stat(f"{folder}/a.bin")
    path.write_bytes(b"y" * len(made["a.bin"]))
    assert status()["a.bin"] == "mismatch"
    os.utime(path, ns=(then.st_atime_ns, then.st_mtime_ns))
    assert status()["a.bin"] == "known" and status(force=True)["a.bin"] == "mismatch"
    report = digests.verify(spark, folder, manifest, ledger, force=True)
    assert [r.name for r in digests.drop_mismatches(report).collect()] == ["a.bin"] and not path.exists()
    assert status()["a.bin"] == "missing" and digests.drop_mismatches(report.where("FALSE")).count() == 0


def test_a_file_of_three_gigabytes_in_constant_memory(spark, tmp_path):
    """Its bytes are a hole, but for the last; the readers' memory does not follow the size."""
    path = tmp_path / "in" / "large"
    path.parent.mkdir()
    with path.open("wb") as f:
        f.seek(3 << 30)
        f.write(b"!")
    want = subprocess.run(["md5sum", path], capture_output=True, text=True).stdout.split()[0]
    found = digests.digests(digests.files(spark, str(tmp_path / "in")))
    peak = F.udf(lambda _: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, "long")
    r = found.withColumn("peak_kb", peak("md5")).first()
    assert (r.size, r.md5) == ((3 << 30) + 1, want) and r.peak_kb < 700_000


def test_command_line(tmp_path):
    folder, made = folder_of(tmp_path)
    (tmp_path / "manifest.json").write_text(str([{"name": n, "md5": md5(d)} for n, d in made.items() if n != "empty"] + [{"name": "empty", "md5": "0"}]).replace("'", '"'))
    run = lambda: subprocess.run([sys.executable, "-m", "sightline", "verify", "--folder", folder, "--manifest", str(tmp_path / "manifest.json"), "--ledger", str(tmp_path / "ledger"), "--remove", "--out", str(tmp_path / "out")], cwd=ROOT, capture_output=True, text=True, timeout=300)
    first, second = run(), run()
    assert first.returncode != 0 and "empty" in first.stderr and not Path(folder, "empty").exists()
    assert second.returncode != 0 and "known" in second.stdout and "missing" in second.stdout
