"""A log that grows, rotates and is cut: every whole line arrives once."""

from __future__ import annotations

import os

import pytest

from modlytics.sources.tail import Folder, TailReader, tail_lines
from modlytics.streaming.logs import stream_logs


def arrive(spark, path, folder, **options):
    """Run the stream over what is there, from its progress on; all lines that have arrived so far."""
    lines = tail_lines(spark, path, **options)
    writer = lines.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return sorted(row["value"] for row in spark.read.schema("value string").parquet(f"{folder}/out").collect())


def write(path, text, mode="a"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(text)


def numbered(first, last):
    return [f"line {i:05d}" for i in range(first, last)]


def text_of(lines):
    return "".join(f"{line}\n" for line in lines)


def test_appended_lines_half_lines_and_a_rotation_arrive_once(spark, folder):
    log = f"{folder}/in/app.log"
    write(log, text_of(numbered(0, 3)) + "line 0")
    assert arrive(spark, log, folder) == numbered(0, 3)
    write(log, "0003\n" + text_of(numbered(4, 7)))
    assert arrive(spark, log, folder) == numbered(0, 7)
    write(log, text_of(numbered(7, 9)))
    os.rename(log, f"{log}.1")
    write(log, text_of(numbered(9, 12)))
    assert arrive(spark, log, folder) == numbered(0, 12)
    assert arrive(spark, log, folder) == numbered(0, 12)
    os.rename(f"{log}.1", f"{log}.2")
    os.rename(log, f"{log}.1")
    write(log, text_of(numbered(12, 13)))
    assert arrive(spark, log, folder) == numbered(0, 13)


def test_a_stretch_is_read_by_many_tasks(spark, folder):
    lines = numbered(0, 2000) + ["", "x" * 5000, "schön"]
    write(f"{folder}/in/a.log", text_of(lines))
    assert arrive(spark, f"{folder}/in", folder, bytes_per_task=700) == sorted(lines)


def test_a_log_that_was_emptied_begins_anew(spark, folder):
    log = f"{folder}/in/app.log"
    write(log, text_of(numbered(0, 5)))
    arrive(spark, log, folder)
    write(log, text_of(["other"]), "w")
    assert arrive(spark, log, folder) == numbered(0, 5) + ["other"]


def test_hidden_and_compressed_files_are_passed_over(folder):
    for name in ("a.log", ".a.log.crc", "b.gz", "_tmp/c.log", "deep/d.log"):
        write(f"{folder}/in/{name}", "x\n")
    assert sorted(Folder(f"{folder}/in").sizes()) == ["a.log", "deep/d.log"]


def test_lines_that_go_before_they_are_read_fail_the_stream_unless_told_otherwise(folder):
    log = f"{folder}/in/app.log"
    write(log, text_of(numbered(0, 3)))
    end = TailReader({"path": log}).latestOffset()
    write(log, text_of(["other"]), "w")
    with pytest.raises(FileNotFoundError):
        TailReader({"path": log}).partitions({}, end)
    assert TailReader({"path": log, "failOnDataLoss": "false"}).partitions({}, end) == []


def test_records_appended_to_a_log_reach_the_log_stream(spark, folder):
    log = f"{folder}/in/log.json"

    def run():
        logs = stream_logs(spark, f"{folder}/in").select("timestamp", "endpoint")
        writer = logs.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        writer.trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{folder}/out").count()

    def record(second):
        return f'{{"timestamp": "2024-03-01 00:00:{second:02d},000", "endpoint": "/predict"}}'

    write(log, text_of([record(i) for i in range(3)]))
    assert run() == 3
    write(log, text_of([record(i) for i in range(3, 7)]))
    assert run() == 7
