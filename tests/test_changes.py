"""Changes of active versions as state of a stream: late, repeated and tied events, null keys, one hot key, restarts."""

from datetime import datetime, timedelta

import pandas as pd
import pytest

from recordshield.streaming.changes import ChangeLog, newest_so_far

SCHEMA = "who long, at timestamp, n long"
START = datetime(2024, 1, 1)


def rows(numbers):
    """A third of all events belong to one key; times tie and go backwards; some keys and times are null."""
    out = []
    for i in numbers:
        who = 1 if i % 3 == 0 else None if i % 11 == 0 else (1 << 60) + i % 7
        out.append((who, None if i % 13 == 0 else START + timedelta(hours=(i * 37) % 50), i))
    return out


def expected(events):
    best = {}
    for who, at, n in set(events):
        rank = (at is not None, at or START, n)
        best[who] = max(best.get(who, rank), rank)
    return {(who, n): "Y" if best[who][2] == n else "N" for who, _, n in events}


@pytest.mark.parametrize("lanes", [1, 4])
def test_late_and_repeated_events(spark, tmp_path, lanes):
    feed, log = str(tmp_path / "feed"), None
    schema = spark.createDataFrame([], SCHEMA).schema
    sent = []
    # the newest first, then late ones with repeats; the second round goes on from the checkpoint
    for batch in (rows(range(60, 120)), rows(range(0, 80)), rows(range(100, 150)) + rows(range(0, 10))):
        spark.createDataFrame(batch, SCHEMA).coalesce(2).write.mode("append").parquet(feed)
        sent += batch
        log = ChangeLog(spark, str(tmp_path / "log"), schema, ("who",), "at", "n", lanes)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(feed)
        log.follow(stream, str(tmp_path / "checkpoint")).awaitTermination()
        got = {(r["who"], r["n"]): r["active_flag"] for r in log.flags().collect()}
        assert got == expected(sent)
    assert log.flags().count() == len(set(sent))


def test_a_repeated_active_version_changes_nothing(spark, tmp_path):
    feed, schema = str(tmp_path / "feed"), spark.createDataFrame([], SCHEMA).schema
    log = ChangeLog(spark, str(tmp_path / "log"), schema, ("who",), "at", "n")
    counts = []
    for _ in range(2):
        spark.createDataFrame([(5, START, 1)], SCHEMA).write.mode("append").parquet(feed)
        log.follow(spark.readStream.schema(schema).parquet(feed), str(tmp_path / "checkpoint")).awaitTermination()
        counts.append(log.changes().count())
    assert counts == [1, 1]


def test_a_chunk_costs_one_frame(monkeypatch):
    """Groups are many and small: their versions are compared as numbers, and only the result is a frame."""
    chunks = [pd.DataFrame({"key": "k", "lane": 0, "at": at, "id": n}) for at, n in (([3, 1, 3], [7, 9, 7]), ([2, 3], [1, 7]), ([4], [0]))]

    class State:
        exists, get = False, None

        def update(self, top):
            self.get = top

    for step in ("sort_values", "drop_duplicates", "assign"):
        monkeypatch.delattr(pd.DataFrame, step)
    state = State()
    out = [set(frame.itertuples(index=False, name=None)) for frame in newest_so_far(("k", 0), iter(chunks), state)]
    assert out == [{("k", 0, 3, 7, "Y"), ("k", 0, 1, 9, "N")}, {("k", 0, 2, 1, "N")}, {("k", 0, 4, 0, "Y"), ("k", 0, 3, 7, "N")}]
    assert state.get == (4, 0)
