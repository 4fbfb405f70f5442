"""Versions of several tables at once."""

import pytest

from voxspark.sources.snapshots import Store, Table

TABLES = {
    "segments": Table("recording_id long, segment_index long, label string", ("recording_id", "segment_index")),
    "recordings": Table("recording_id long, name string", ("recording_id",)),
}


def frames(spark, segments, recordings):
    return {"segments": spark.createDataFrame(segments, TABLES["segments"].schema), "recordings": spark.createDataFrame(recordings, TABLES["recordings"].schema)}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upserts_deletes_and_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), TABLES, buckets=4)
    assert store.versions() == [] and rows(store.read("segments")) == []
    store.publish(0, frames(spark, [(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (None, 0, "n")], [(1, "one"), (2, "two")]))
    store.publish(1, frames(spark, [(1, 1, "B"), (3, 0, "d"), (None, 0, "N")], []), {"recordings": spark.createDataFrame([(2,)], "recording_id long")})
    assert rows(store.read("segments")) == rows(spark.createDataFrame([(1, 0, "a"), (1, 1, "B"), (2, 0, "c"), (3, 0, "d"), (None, 0, "N")], TABLES["segments"].schema))
    assert rows(store.read("recordings")) == [(1, "one")]
    assert rows(store.read("recordings", 0)) == [(1, "one"), (2, "two")]
    store.publish(1, frames(spark, [(9, 9, "x")], []))  # tried again: nothing changes
    assert not any(r[0] == 9 for r in rows(store.read("segments")))
    store.publish(2, {}, {"segments": store.read("segments")})
    assert rows(store.read("segments")) == [] and store.keep(1) == 2 and store.versions() == [2]
    assert rows(store.read("recordings")) == [(1, "one")]


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), TABLES, buckets=2)
    store.publish(0, frames(spark, [(1, 0, "a")], [(1, "one")]))
    bad = frames(spark, [(1, 0, "new")], [(1, "new")])
    bad["segments"] = bad["segments"].selectExpr("recording_id", "segment_index", "raise_error(label) AS label")
    with pytest.raises(Exception, match="new"):
        store.publish(1, bad)  # recordings are written by then, the pointer is not
    assert store.versions() == [0] and rows(store.read("recordings")) == [(1, "one")] and rows(store.read("segments")) == [(1, 0, "a")]
    store.publish(1, frames(spark, [(1, 0, "new")], [(1, "new")]))
    assert rows(store.read("recordings")) == [(1, "new")]
