"""Late rows, several files, and the folder streams and checkpoints go to."""

from __future__ import annotations

import datetime as dt
import os
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from brindle import session
from brindle.sources import SCHEMAS, Tables
from oracle import connect, differences
from brindle.plans import ALL
from brindle.streaming import (
    forget,
    read_stream,
    run_append,
    run_complete,
    session_counts,
    tumbling_counts,
)

START = dt.datetime(2024, 1, 1)


def minutes(n: float) -> dt.datetime:
    return START + dt.timedelta(minutes=n)


def write_files(folder, files: list[list[float]], start: int = 0) -> str:
    """One file for each list of event minutes, taken in this order."""
    target = folder / "events.parquet"
    target.mkdir(exist_ok=True)
    ids = iter(range(10**6))
    for i, times in enumerate(files, start):
        path = target / f"part-{i}.parquet"
        pq.write_table(pa.table({
            "event_id": pa.array([next(ids) for _ in times], pa.int64()),
            "ts": pa.array([minutes(m) for m in times], pa.timestamp("us")),
            "user_id": pa.array([1 for _ in times], pa.int64()),
            "event_type": pa.array(["view" for _ in times]),
            "value": pa.array([1.0 for _ in times]),
            "props": pa.array(["{}" for _ in times]),
        }), path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(folder)


def test_late_rows_count_until_the_watermark_has_passed_their_window(spark, tmp_path):
    # Spark drops late rows by the watermark one batch older than the one it closes windows by.
    folder = write_files(tmp_path, [
        [1, 5, 61, 65],        # watermark 55 after this file
        [50, 58, 130],         # late, but their hour is open; watermark 120 after it
        [3, 131],              # still judged by 55: the first hour takes it, then closes
        [2, 59, 110, 132],     # judged by 120: the first two hours are closed
        [200],                 # lifts the watermark over the third hour
    ])
    stream = read_stream(spark, folder, "events", "ts", "10 minutes", files_per_trigger=1)
    found = run_append(tumbling_counts(stream, "ts", "event_type", "1 hour"))
    counts = {r.window_start: r.n for r in found.collect()}
    assert counts == {minutes(0): 5, minutes(60): 2, minutes(120): 3}


def test_sessions_merge_across_files(spark, tmp_path):
    folder = write_files(tmp_path, [[0, 4], [8, 30], [12, 33], [100]])
    stream = read_stream(spark, folder, "events", "ts", "30 minutes", files_per_trigger=1)
    found = run_append(session_counts(stream, "ts", "user_id", "5 minutes"))
    assert sorted((r.window_start, r.window_end, r.n) for r in found.collect()) == [
        (minutes(0), minutes(17), 4), (minutes(30), minutes(38), 2)]


def test_complete_mode_keeps_the_last_result(spark, tmp_path):
    folder = write_files(tmp_path, [[1], [2, 61], [62, 3]])
    stream = read_stream(spark, folder, "events", "ts", "10 minutes", files_per_trigger=1)
    path = str(tmp_path / "kept")
    found = run_complete(tumbling_counts(stream, "ts", "event_type", "1 hour"), path)
    # of three batches' results the last two are there
    assert sorted(n for n in os.listdir(path) if n.startswith("rows")) == ["rows-1", "rows-2"]
    assert Counter({r.window_start: r.n for r in found.collect()}) == {
        minutes(0): 3, minutes(60): 2}


@pytest.mark.parametrize("run, first, second", [
    (run_append, {0: 2}, {0: 2, 60: 2}),
    (run_complete, {0: 2, 60: 1}, {0: 2, 60: 2, 180: 1}),
])
def test_a_stream_goes_on_where_it_stopped(spark, tmp_path, run, first, second):
    path = str(tmp_path / "kept")

    def counts() -> dict:
        stream = read_stream(spark, str(tmp_path), "events", "ts", "10 minutes")
        found = run(tumbling_counts(stream, "ts", "event_type", "1 hour"), path)
        return {r.window_start: r.n for r in found.collect()}

    write_files(tmp_path, [[1, 2, 75]])
    assert counts() == {minutes(m): n for m, n in first.items()}
    write_files(tmp_path, [[80, 190]], start=1)
    assert counts() == {minutes(m): n for m, n in second.items()}


@pytest.mark.parametrize("name", sorted(n for n in ALL if n.startswith("stream_")))
def test_registered_streams_over_several_files_in_order(spark, small, tmp_path, name, monkeypatch):
    """With a batch for each file there are no late rows, and the SQL holds."""
    monkeypatch.setattr("brindle.plans.streams.FILES_PER_TRIGGER", 1)
    events = pq.read_table(f"{small}/events.parquet").sort_by("ts")
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    for i in range(4):
        path = folder / f"part-{i}.parquet"
        pq.write_table(events.slice(i * 250, 250), path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    for table in SCHEMAS:
        if table != "events":
            os.symlink(f"{small}/{table}.parquet", tmp_path / f"{table}.parquet")
    found = ALL[name].build(Tables(spark, str(tmp_path)))
    assert differences(found, connect(str(tmp_path)), ALL[name].sql) == []


def test_two_streams_at_once_and_settings_stay_as_they_were(spark, tmp_path):
    folder = write_files(tmp_path, [[1, 2, 75], [80, 190]])
    before = dict(spark.conf.getAll)

    def run(i: int) -> int:
        stream = read_stream(spark, folder, "events", "ts", "10 minutes")
        path = str(tmp_path / f"run-{i}")
        return run_append(tumbling_counts(stream, "ts", "event_type", "1 hour"), path).count()

    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(run, range(2))) == [2, 2]
    assert dict(spark.conf.getAll) == before


def test_a_run_can_be_forgotten(spark, tmp_path):
    folder = write_files(tmp_path, [[1]])
    path = str(tmp_path / "kept")
    stream = read_stream(spark, folder, "events", "ts", "10 minutes")
    run_complete(tumbling_counts(stream, "ts", "event_type", "1 hour"), path)
    assert os.path.isdir(path)
    forget(spark, path)
    assert not os.path.exists(path)


def test_window_functions_work_on_tables_too(spark, small):
    events = Tables(spark, small).events
    found = tumbling_counts(events, "ts", "event_type", "1 hour")
    assert found.agg(F.sum("n")).first()[0] == events.count()


def test_checkpoint_folder_is_read_from_the_session(spark):
    named = session.checkpoint_folder(spark)
    assert named == spark.conf.get(session.CHECKPOINT_DIR, named)
    assert spark.sparkContext.getCheckpointDir() is not None
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")


def fake_session(master: str, named: str | None):
    used = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None,
                              setCheckpointDir=used.append)
    conf = SimpleNamespace(get=lambda key, default: named or default)
    return SimpleNamespace(sparkContext=context, conf=conf), used


def test_a_cluster_must_name_its_folder():
    unnamed, _ = fake_session("yarn", None)
    with pytest.raises(RuntimeError, match=session.CHECKPOINT_DIR):
        session.checkpoint_folder(unnamed)
    named, used = fake_session("yarn", "hdfs:///checkpoints")
    assert session.checkpoint_folder(named) == "hdfs:///checkpoints"
    assert used == ["hdfs:///checkpoints"]


def test_schemas_are_those_of_the_files(spark, small):
    for name, schema in SCHEMAS.items():
        stored = spark.read.parquet(f"{small}/{name}.parquet")
        given = getattr(Tables(spark, small), name)
        assert stored.dtypes == given.dtypes, (name, schema)
