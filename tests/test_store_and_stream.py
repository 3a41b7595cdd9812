"""Commits exclude each other; a stream tells repeated events apart however late they come."""

import datetime

import pytest

from codeloom.operators import store
from codeloom.schema import empty_graph
from codeloom.streaming import events


def test_two_writers_of_one_version_conflict(spark, tmp_path):
    s = store.SnapshotStore(spark, str(tmp_path))
    assert s.version() == 0
    s.commit(empty_graph(spark))
    loaded = s.version()
    assert s.commit(empty_graph(spark), after=loaded) == 2
    with pytest.raises(store.Conflict):
        s.commit(empty_graph(spark), after=loaded)
    assert s.version() == 2 and s.load().units.count() == 0


def test_late_repeats_and_late_events_count_once(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    rows = [(i, day + datetime.timedelta(days=200 * (i % 7)), i % 3, "click") for i in range(40)]
    for n, part in enumerate((rows[30:], rows[:20], rows[10:30], rows[:3] + [(99, day - datetime.timedelta(days=4000), 1, "error")])):
        spark.createDataFrame(part, "event_id long, ts timestamp, user_id long, event_type string").coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    got = {r["file"]: (r["eventId"], r["n"]) for r in events.run_stream(spark, str(tmp_path / "events"), files_per_batch=1).collect()}
    want = {f"cust/c{u}.java": (max((ts, i) for i, ts, k, _ in rows if k == u)[1], sum(k == u for _, _, k, _ in rows) + (u == 1)) for u in range(3)}
    assert got == want
