"""Each stream must equal the batch query on the same files."""

import os
import tempfile
import time

from pyspark.sql import functions as F

from ticketlens import schemas
from ticketlens.operators import analytics as A
from ticketlens.operators import review, scoring
from ticketlens.plans import queries as Q
from ticketlens.sources import io
from ticketlens.sources import tables as T
from ticketlens.sources.commit_log import CommitLog
from ticketlens.streaming import triage as ST

SF = "/root/testdata/sf0.001"


def _tmp():
    return tempfile.mkdtemp(prefix="tl-stream-", dir="/tmp")


def _write_log(spark, path, in_time_order=True):
    log = T.predictions(spark, SF).select(*schemas.PREDICTIONS.fieldNames())
    if in_time_order:   # files arrive one after another, in event-time order
        cuts = list(log.select(F.percentile_approx("timestamp", [0.25, 0.5, 0.75])).first()[0])
        bounds = [None] + cuts + [None]
        for lo, hi in zip(bounds, bounds[1:]):
            part = log
            if lo is not None:
                part = part.where(F.col("timestamp") >= F.lit(lo))
            if hi is not None:
                part = part.where(F.col("timestamp") < F.lit(hi))
            part.coalesce(1).write.mode("append").parquet(path)
            time.sleep(1.1)   # distinct file modification times
    else:               # every file spans the whole period
        log.repartition(4, "id").write.mode("overwrite").parquet(path)
    return spark.read.schema(schemas.PREDICTIONS).parquet(path)


def test_daily_counts_stream_equals_batch_for_closed_days(spark):
    base = _tmp()
    log = _write_log(spark, os.path.join(base, "log"))
    out = os.path.join(base, "daily")
    q = ST.start_append(ST.daily_counts_stream(ST.read_log_stream(spark, os.path.join(base, "log"), 1)),
                        out, os.path.join(base, "ck"))
    q.awaitTermination(300)
    got = {r.date: r.n for r in spark.read.parquet(out).collect()}
    want = {r.date: r.n for r in A.daily_counts(log).collect()}
    last = max(want)
    assert got, "no closed day emitted"
    assert last not in got or got[last] == want[last]
    for d, n in got.items():
        assert want[d] == n
    # every day whose window closed before the final watermark is present
    assert set(want) - set(got) <= {last}


def test_daily_counts_stream_drops_late_rows(spark):
    base = _tmp()
    log = _write_log(spark, os.path.join(base, "log"), in_time_order=False)
    out = os.path.join(base, "daily")
    q = ST.start_append(ST.daily_counts_stream(ST.read_log_stream(spark, os.path.join(base, "log"), 1)),
                        out, os.path.join(base, "ck"))
    q.awaitTermination(300)
    got = {r.date: r.n for r in spark.read.parquet(out).collect()}
    want = {r.date: r.n for r in A.daily_counts(log).collect()}
    # rows of later files behind the watermark are dropped, never double counted
    assert got and all(got[d] <= want[d] for d in got)
    assert sum(got.values()) < sum(want[d] for d in got)


def test_review_feed_stream_equals_batch(spark):
    base = _tmp()
    log = _write_log(spark, os.path.join(base, "log"))
    out = os.path.join(base, "feed")
    q = ST.start_append(ST.review_feed_stream(ST.read_log_stream(spark, os.path.join(base, "log"))),
                        out, os.path.join(base, "ck"))
    q.awaitTermination(300)
    got = sorted(r.id for r in spark.read.parquet(out).collect())
    want = sorted(r.id for r in review.open_items(log).collect())
    assert got == want and got


def test_triage_stream_equals_batch_and_replay_safe(spark):
    base = _tmp()
    src = os.path.join(base, "in")
    et = T.embedded_tickets(spark, SF).where("embedding is not null")
    et.repartition(3, "ticket_id").write.parquet(src)
    heads = Q.heads(spark, SF)
    stream_in = spark.readStream.schema(et.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = os.path.join(base, "log")
    ck = os.path.join(base, "ck")
    q = ST.start_triage(ST.triage_stream(stream_in, heads), out, ck)
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    assert got.select("batch_id").distinct().count() == 3
    batch = scoring.score(et, "embedding", heads, keep=("ticket_id",))
    g = {r.id: (r.pred_category, r.pred_priority, r.pred_sentiment, r.confidence, r.requires_review)
         for r in got.collect()}
    b = {r.ticket_id: (r.pred_category, r.pred_priority, r.pred_sentiment, r.confidence, r.requires_review)
         for r in batch.collect()}
    assert g == b
    # a restart on the same checkpoint finds nothing new: no duplicates
    q2 = ST.start_triage(ST.triage_stream(
        spark.readStream.schema(et.schema).parquet(src), heads), out, ck)
    q2.awaitTermination(300)
    assert spark.read.parquet(out).count() == len(b)


def test_feed_restart_with_more_files_loses_nothing(spark):
    """Started, files added, started again with other batch sizes: the
    stream's output equals the batch query."""
    base = _tmp()
    src, out, ck = (os.path.join(base, x) for x in ("log", "feed", "ck"))
    log = T.predictions(spark, SF).select(*schemas.PREDICTIONS.fieldNames())
    log.where("id % 2 = 0").repartition(3).write.parquet(src)
    ST.start_append(ST.review_feed_stream(ST.read_log_stream(spark, src, 1)), out, ck).awaitTermination(300)
    log.where("id % 2 = 1").repartition(2).write.mode("append").parquet(src)
    ST.start_append(ST.review_feed_stream(ST.read_log_stream(spark, src, 2)), out, ck).awaitTermination(300)
    got = sorted(r.id for r in spark.read.parquet(out).collect())
    assert got == sorted(r.id for r in review.open_items(log).collect()) and got


def test_triage_restart_with_more_files_equals_batch(spark):
    base = _tmp()
    src, out, ck = (os.path.join(base, x) for x in ("in", "log", "ck"))
    et = T.embedded_tickets(spark, SF).where("embedding is not null")
    heads = Q.heads(spark, SF)

    def start(files):
        stream = spark.readStream.schema(et.schema).option("maxFilesPerTrigger", files).parquet(src)
        ST.start_triage(ST.triage_stream(stream, heads), out, ck).awaitTermination(300)

    et.where("ticket_id % 2 = 0").repartition(3).write.parquet(src)
    start(1)
    et.where("ticket_id % 2 = 1").repartition(2).write.mode("append").parquet(src)
    start(2)
    want = {r.ticket_id: r.pred_category for r in scoring.score(et, "embedding", heads, keep=("ticket_id",)).collect()}
    rows = spark.read.parquet(out).collect()
    assert len(rows) == len(want) and {r.id: r.pred_category for r in rows} == want


def test_stream_log_and_quarantine_are_all_tickets(spark):
    """Tickets without features or text are quarantined, and the log's rows
    are those of the batch."""
    base = _tmp()
    src = os.path.join(base, "in")
    et = T.embedded_tickets(spark, SF).withColumn("subject", F.when(F.col("ticket_id") % 11 == 0, "").otherwise(F.col("subject"))).withColumn(
        "embedding", F.when(F.col("ticket_id") % 13 != 0, F.col("embedding")))
    et.repartition(3, "ticket_id").write.parquet(src)
    heads = Q.heads(spark, SF)
    tickets = lambda: spark.readStream.schema(et.schema).option("maxFilesPerTrigger", 1).parquet(src)
    log = CommitLog(spark, os.path.join(base, "log"))
    ST.start_committed(ST.triage_stream(tickets(), heads), log, os.path.join(base, "ck")).awaitTermination(300)
    ST.start_append(ST.quarantine_stream(tickets()).select("ticket_id", "reject_reason"), os.path.join(base, "bad"), os.path.join(base, "ck2")).awaitTermination(300)
    rows, bad = log.read().collect(), spark.read.parquet(os.path.join(base, "bad")).collect()
    assert len(rows) + len(bad) == et.count() and {r.reject_reason for r in bad} == {"subject_empty", "embedding_missing"}
    assert {r.id for r in rows} | {r.ticket_id for r in bad} == {r.ticket_id for r in et.collect()}
    assert all(r.pred_category is not None and r.confidence is not None for r in rows)
    valid, _ = io.split_valid(et, features="embedding")
    want = {r.ticket_id: (r.pred_category, r.confidence) for r in scoring.score(valid, "embedding", heads, keep=("ticket_id",)).collect()}
    assert {r.id: (r.pred_category, r.confidence) for r in rows} == want


def test_replayed_stream_writes_the_same_log(spark):
    """The stream loses its checkpoint after it has committed: the batches
    come again under the same ids and are skipped; times are data."""
    base = _tmp()
    src = os.path.join(base, "in")
    et = T.embedded_tickets(spark, SF).where("embedding is not null").withColumn("timestamp", F.lit("2025-03-04 05:06:07").cast("timestamp"))
    et.repartition(3, "ticket_id").write.parquet(src)
    heads, log = Q.heads(spark, SF), CommitLog(spark, os.path.join(base, "log"))

    def start(checkpoint):
        stream = spark.readStream.schema(et.schema).option("maxFilesPerTrigger", 1).parquet(src)
        ST.start_committed(ST.triage_stream(stream, heads), log, os.path.join(base, checkpoint)).awaitTermination(300)
        return sorted(tuple(r) for r in log.read().collect())

    first = start("ck")
    assert len(log.batches()) == 3 and start("fresh") == first and len(first) == et.count()
    assert {r[10].isoformat() for r in first} == {"2025-03-04T05:06:07"}


def test_replayed_files_change_no_count(spark):
    """Every file comes twice; the stream counts as the batch over distinct
    ids."""
    base = _tmp()
    log = T.predictions(spark, SF).select(*schemas.PREDICTIONS.fieldNames())
    days = sorted(r[0] for r in log.select(F.to_date("timestamp")).distinct().collect())[:3]
    path = os.path.join(base, "log")
    for day in days:
        for _ in range(2):
            log.where(F.to_date("timestamp") == F.lit(day)).coalesce(1).write.mode("append").parquet(path)
            time.sleep(1.1)
    out = os.path.join(base, "daily")
    q = ST.start_append(ST.daily_counts_stream(ST.read_log_stream(spark, path, 1), delay="2 days", distinct=True), out, os.path.join(base, "ck"))
    q.awaitTermination(300)
    got = {r.date: r.n for r in spark.read.parquet(out).collect()}
    want = {r.date: r.n for r in A.daily_counts(spark.read.schema(schemas.PREDICTIONS).parquet(path).dropDuplicates(["id"])).collect()}
    assert set(got) <= set(want) and all(want[d] == n for d, n in got.items())
    plain = os.path.join(base, "plain")
    ST.start_append(ST.daily_counts_stream(ST.read_log_stream(spark, path, 1), delay="0 seconds"), plain, os.path.join(base, "ck2")).awaitTermination(300)
    doubled = {r.date: r.n for r in spark.read.parquet(plain).collect()}
    assert doubled and all(n == 2 * want[d] for d, n in doubled.items())
