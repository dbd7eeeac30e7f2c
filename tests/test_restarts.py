"""Streams that stop and go on in the place they are given."""

from strandwork.streaming import appends
from strandwork.streaming.common import drain

SHAPE = "slot long, seq long, base long"


def arrive(spark, inbox, rows):
    spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(inbox)
    return spark.readStream.schema(SHAPE).parquet(inbox)


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    inbox, place = str(tmp_path / "in"), str(tmp_path / "place")
    first = drain(arrive(spark, inbox, [(1, 1, 0), (1, 2, 0)]), "x", place=place)
    assert sorted(r.seq for r in first.collect()) == [1, 2]
    again = drain(spark.readStream.schema(SHAPE).parquet(inbox), "x", place=place)
    assert again.count() == 2  # nothing new: nothing is read twice
    assert sorted(r.seq for r in drain(arrive(spark, inbox, [(1, 3, 0)]), "x", place=place).collect()) == [1, 2, 3]
    assert drain(spark.readStream.schema(SHAPE).parquet(inbox), "x").count() == 3  # without a place a stream begins anew


def test_keys_are_appended_once_over_restarts(spark, tmp_path):
    inbox, place = str(tmp_path / "in"), str(tmp_path / "place")
    appends.append_once(arrive(spark, inbox, [(1, 1, 0), (1, 9, 0), (None, 2, 0)]), "slot", "x", place)
    rows = appends.append_once(arrive(spark, inbox, [(1, 3, 0), (2, 4, 0), (None, 5, 0)]), "slot", "x", place).collect()
    assert sorted(str(r.slot) for r in rows) == ["1", "2", "None"] and {r.seq for r in rows} <= {1, 9, 2, 4} and 4 in {r.seq for r in rows}


def test_publication_goes_on_from_the_heads_of_earlier_runs(spark, tmp_path):
    inbox, place = str(tmp_path / "in"), str(tmp_path / "place")
    appends.publish_if_current(arrive(spark, inbox, [(1, 5, 0), (1, 4, 0), (2, 6, 1)]), "x", place)
    appends.publish_if_current(arrive(spark, inbox, [(1, 7, 0), (1, 8, 1), (2, 9, 0)]), "x", place)
    got = appends.publish_if_current(arrive(spark, inbox, [(1, 10, 2), (2, 11, 1), (3, 12, 1)]), "x", place)
    assert {r.seq for r in got.where("outcome = 'published'").collect()} == {4, 8, 9, 10, 11} and got.count() == 9
