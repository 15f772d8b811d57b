"""Streams that arrive in parts and restart from their checkpoint."""

import datetime as dt

import pytest

from trailspark.binding.catalog import QUERIES
from trailspark.schema import EVENT_SCHEMA
from trailspark.session import scratch_path
from trailspark.streaming import detections


def append(spark, folder, *rows):
    full = [tuple(row.get(name) for name in EVENT_SCHEMA.names) for row in rows]
    spark.createDataFrame(full, EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def at(hour, minute=0, **row):
    return {"date_jst": dt.datetime(2024, 1, 3, hour, minute), "actor": "a", "action": "x", **row}


class Job:
    """A stream from a folder to a folder, run until it has read everything."""

    def __init__(self, spark, make):
        self.spark, self.make = spark, make
        self.source, self.sink, self.checkpoint = (scratch_path(spark, name) for name in ("in", "out", "state"))

    def run(self, *rows):
        append(self.spark, self.source, *rows)
        stream = self.make(self.spark.readStream.schema(EVENT_SCHEMA).parquet(self.source))
        detections.write_stream(stream, self.sink, self.checkpoint).awaitTermination()
        return [tuple(row) for row in self.spark.read.schema(stream.schema).parquet(self.sink).collect()]


def test_bulk_counts_are_complete_over_batches_and_restarts(spark):
    source, counts, checkpoint = (scratch_path(spark, name) for name in ("in", "counts", "state"))

    def run(*rows):
        append(spark, source, *rows)
        detections.count_stream(spark.readStream.schema(EVENT_SCHEMA).parquet(source), counts, checkpoint).awaitTermination()
        return {tuple(row) for row in detections.bulk_alerts(spark, counts, 2).collect()}

    nine = dt.datetime(2024, 1, 3, 9)
    assert run(at(9), at(9, 59), at(9, 30, actor="b"), at(10, 30)) == set()
    # A restart: the hour goes on where it was.
    assert run(at(9, 45), at(11)) == {("a", "x", nine, 3)}
    # Events a year late count as well, and null actions are a group.
    old = dt.datetime(2023, 1, 3, 9)
    late = [{**at(9), "date_jst": old.replace(minute=m)} for m in range(3)]
    assert run(*late, *[at(13, m, action=None) for m in range(3)]) == {
        ("a", "x", nine, 3), ("a", "x", old, 3), ("a", None, dt.datetime(2024, 1, 3, 13), 3),
    }


def test_streams_read_a_table_of_several_files(spark, sf_dir):
    folder = scratch_path(spark, "split")
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(5).write.parquet(f"{folder}/events.parquet")
    for name in ("e1_bulk_operation_stream", "e2_critical_event_stream"):
        rows = {tuple(row) for row in QUERIES[name](spark, folder).collect()}
        assert rows and rows == {tuple(row) for row in QUERIES[name](spark, sf_dir).collect()}


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Cluster:
        conf, sparkContext = Conf(), type("C", (), {"master": "spark://host:7077", "applicationId": "app"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(Cluster(), "x")
    assert scratch_path(Cluster(), "x", "/shared").startswith("/shared/trailspark/app/x-")


def test_critical_events_pass_through(spark):
    job = Job(spark, detections.critical_event_stream)
    assert job.run(at(9), at(9, action="repo.destroy"))[0][1] == "repo.destroy"
    assert len(job.run(at(8, action="hook.create"), at(8))) == 2
