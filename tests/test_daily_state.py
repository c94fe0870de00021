"""The states by day equal a full scan after any mix of appends."""

import datetime as dt
import random

import pytest

from ticketlens import schemas
from ticketlens.operators import analytics as A
from ticketlens.operators.daily_state import PARTS, DailyState
from ticketlens.operators.segments import Conflict
from ticketlens.sources.commit_log import CommitLog


def rows(spark, seed, days, n=30):
    rng = random.Random(seed)
    return spark.createDataFrame([
        (seed * 1000 + k, "s", "d", rng.choice("abc"), rng.choice(["High", "Low"]), rng.choice(["Neutral", "Positive"]), round(rng.random(), 4), rng.random() * 9,
         rng.choice([True, False, None]), False, dt.datetime(2025, 1, rng.choice(days), rng.randrange(24), 5)) for k in range(n)], schemas.PREDICTIONS)


def same(state, log):
    got, want = state.bundle().head().asDict(recursive=True), A.bundle(log.read()).head().asDict(recursive=True)
    for k in ("avg_confidence", "avg_latency_ms"):
        assert got.pop(k) == pytest.approx(want.pop(k), abs=1e-9)
    assert got == want


def test_appends_and_late_rows_equal_a_full_scan(spark, tmp_path):
    log, state = CommitLog(spark, str(tmp_path / "log")), DailyState(spark, str(tmp_path / "state"))
    same(state, log)
    log.append(rows(spark, 1, [1, 2]), "b1")
    log.append(rows(spark, 2, [2, 3]), "b2")
    took = state.refresh(log)
    assert took["batches"] == ["b1", "b2"] and took["days"] == ["2025-01-01", "2025-01-02", "2025-01-03"] and took["rows"] == 60
    same(state, log)
    log.append(rows(spark, 3, [4]), "b3")
    log.append(rows(spark, 4, [1], n=3), "late")  # rows of an old day
    took = state.refresh(log)
    assert took == {"batches": ["b3", "late"], "days": ["2025-01-01", "2025-01-04"], "rows": 33}  # only what is new was read
    same(state, log)
    assert state.refresh(log) == {"batches": [], "days": [], "rows": 0}
    part = state.bundle("2025-01-02", "2025-01-03").head()
    assert part.total_tickets == log.read().where("day between '2025-01-02' and '2025-01-03'").count()


def test_merged_parts_compacted_logs_and_two_writers(spark, tmp_path, monkeypatch):
    log, state = CommitLog(spark, str(tmp_path / "log")), DailyState(spark, str(tmp_path / "state"))
    for k in range(PARTS + 2):
        log.append(rows(spark, 10 + k, [1 + k % 3], n=5), f"b{k}")
        assert state.refresh(log)["rows"] == 5
    assert len(state.version()["parts"]) <= PARTS
    same(state, log)
    log.append(rows(spark, 50, [9], n=4), "new")
    log.compact()  # the new batch is now among the files of all others
    assert state.refresh(log) == {"batches": ["new"], "days": ["2025-01-09"], "rows": 4}
    same(state, log)
    log.append(rows(spark, 51, [9], n=4), "newer")
    old = state.version()
    other = DailyState(spark, str(tmp_path / "state"))
    other.refresh(log)
    monkeypatch.setattr(state, "version", lambda: old)
    with pytest.raises(Conflict):
        state.refresh(log)
    monkeypatch.undo()
    same(state, log)
