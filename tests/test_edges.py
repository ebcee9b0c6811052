"""Bearings at the very edge of a bin fall to the side to which the SQL engine's functions put them."""

import duckdb

from sightline.plans import catalogue

#: Frames in which some bearing is within rounding of a bin's edge.
FRAMES = (1284, 4820, 16033, 17290, 21866, 30746, 33236, 35164)


def test_bins_at_edges(spark, tmp_path):
    spark.createDataFrame([(12 * f + i,) for f in FRAMES for i in range(12)], "event_id long").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    mine = catalogue.QUERIES["corner_bins"](spark, str(tmp_path))
    theirs = con.sql(catalogue.ORACLES["corner_bins"])
    rows = sorted(map(tuple, mine.select(*theirs.columns).collect()), key=str)
    assert len(rows) == 8 * 12 * 60 and rows == sorted(theirs.fetchall(), key=str)
