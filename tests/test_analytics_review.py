import datetime as dt

from pyspark.sql import functions as F

from ticketlens import schemas
from ticketlens.operators import analytics as A
from ticketlens.operators import review as R

T0 = dt.datetime(2025, 1, 1, 10, 0, 0)


def _log(spark, rows):
    return spark.createDataFrame(rows, schemas.PREDICTIONS)


def _row(i, conf, flag, reviewed, ts, cat="Billing", pri="High", sen="Neutral", lat=1.0):
    return (i, f"s{i}", f"d{i}", cat, pri, sen, conf, lat, flag, reviewed, ts)


def test_empty_log_bundle(spark):
    b = A.bundle(_log(spark, [])).collect()[0]
    assert b.total_tickets == 0 and b.avg_confidence == 0.0 and b.avg_latency_ms == 0.0
    assert b.flagged_for_review == 0
    assert b.category_dist == {} and b.tickets_over_time == []
    k = A.kpis(_log(spark, [])).collect()[0]
    assert tuple(k) == (0, 0.0, 0.0, 0)


def test_bundle_equals_separate_queries(spark):
    rows = [_row(i, 0.5 + i / 100, i % 2 == 0, False, T0 + dt.timedelta(hours=7 * i),
                 cat=["A", "B", "C"][i % 3], pri=["High", "Low"][i % 2], lat=i * 1.5) for i in range(20)]
    log = _log(spark, rows)
    b = A.bundle(log).collect()[0]
    assert b.total_tickets == 20
    assert b.category_dist == {r[0]: r[1] for r in A.distribution(log, "pred_category").collect()}
    assert b.priority_dist == {r[0]: r[1] for r in A.distribution(log, "pred_priority").collect()}
    series = [(r.date, r.n) for r in A.daily_counts(log).collect()]
    assert [(s.date, s["count"]) for s in b.tickets_over_time] == series
    k = A.kpis(log).collect()[0]
    assert (b.avg_confidence, b.avg_latency_ms, b.flagged_for_review) == (
        k.avg_confidence, k.avg_latency_ms, k.flagged_for_review)


def test_queue_rules(spark):
    rows = [_row(i, 0.5, True, False, T0 + dt.timedelta(minutes=i)) for i in range(51)]
    rows.append(_row(100, 0.5, True, False, T0 + dt.timedelta(minutes=50)))   # tie with id 50
    rows.append(_row(101, 0.5, None, False, T0 + dt.timedelta(days=1)))       # null flag
    rows.append(_row(102, 0.5, True, None, T0 + dt.timedelta(days=1)))        # null reviewed
    rows.append(_row(103, 0.5, True, True, T0 + dt.timedelta(days=1)))        # reviewed
    q = R.review_queue(_log(spark, rows)).collect()
    assert len(q) == 50
    assert [r.id for r in q[:2]] == [100, 50]
    assert {101, 102, 103}.isdisjoint({r.id for r in q})


def test_mark_reviewed_idempotent_and_unknown(spark):
    log = _log(spark, [_row(i, 0.5, True, False, T0) for i in range(5)])
    acts = spark.createDataFrame([(1, T0), (1, T0), (3, T0), (99, T0)], schemas.REVIEW_ACTIONS)
    cur = R.apply_review_actions(log, acts)
    assert cur.count() == 5
    assert sorted(r.id for r in cur.where("reviewed").collect()) == [1, 3]
    assert [r.ticket_id for r in R.unknown_review_ids(log, acts).collect()] == [99]
    assert [r.id for r in R.review_queue(cur).collect()] == [4, 2, 0]


def test_batch_summary(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, False), (2.5, True)], "latency_ms double, requires_review boolean")
    r = A.batch_summary(df).collect()[0]
    assert tuple(r) == (3, round(5.5 / 3, 3), 2)


def test_lookup_and_preview(spark):
    from ticketlens.sources import io
    log = _log(spark, [_row(i, 0.5, True, False, T0) for i in range(8)])
    ids = spark.createDataFrame([(3,), (3,), (5,), (42,)], "ticket_id long")
    assert sorted(r.id for r in R.lookup(log, ids).collect()) == [3, 5]
    assert [r.id for r in io.preview(log, F.col("id").desc()).collect()] == [7, 6, 5, 4, 3]
