"""Streaming jobs.

R1  triage: new ticket files -> validation, serving text, the three
    linear heads (stateless) -> prediction-log rows. A micro-batch is one
    batch of the exactly-once log (``start_committed``), or goes into a
    ``batch_id`` partition with dynamic overwrite (``start_triage``); either
    way a replayed batch is never there twice. Tickets without text or
    features go to the quarantine stream, so log and quarantine together
    are all tickets. The log's time is the tickets' own where they have
    one, so a replay writes the same rows.
R2  daily counts: the log as a stream -> event-time watermark -> one
    day tumbling windows -> append mode; a day is emitted once the
    watermark passes its end, rows later than the watermark are dropped,
    and repeated log ids count once if asked for.
R3  review feed: stateless filter of flagged, unreviewed rows (the
    newest-50 queue stays a batch query over the sink).

A checkpoint must be given: a query that is started again continues only
from the checkpoint it was started with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens import schemas
from ticketlens.functions import scalar as S
from ticketlens.functions.text import serving_text
from ticketlens.operators import review, scoring
from ticketlens.sources import io
from ticketlens.sources.commit_log import CommitLog

DAY = "1 day"


# -- R2 / R3 over the prediction log --------------------------------------------

def read_log_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schemas.PREDICTIONS)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def daily_counts_stream(log: DataFrame, delay: str = "1 hour", distinct: bool = False) -> DataFrame:
    """R2: tickets per UTC day with a watermark; append-mode safe. With
    ``distinct`` a log id counts once, however often its row comes within
    the watermark (replayed files); the state holds the ids of that time."""
    rows = log.withWatermark("timestamp", delay)
    if distinct:
        rows = rows.dropDuplicatesWithinWatermark(["id"])
    return (rows.groupBy(F.window("timestamp", DAY).alias("w"))
            .agg(F.count("id").alias("n"))
            .select(S.day_bucket(F.col("w.start")).alias("date"), "n"))


def review_feed_stream(log: DataFrame) -> DataFrame:
    """Rows that enter the review queue."""
    return review.open_items(log).select(*review.QUEUE_COLUMNS)


def start_append(df: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    w = (df.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start(path)


# -- R1: streaming triage -----------------------------------------------------

def triage_stream(tickets: DataFrame, heads: dict, features: str = "embedding",
                  id_col: str = "ticket_id", time_col: str = "timestamp") -> DataFrame:
    """Stateless scoring of a ticket stream into log rows. Invalid
    rows are dropped here and reported by ``quarantine_stream``."""
    valid = io.validate(tickets, features=features).where(F.col("reject_reason").isNull())
    own_time = [time_col] if time_col in tickets.columns else []
    scored = scoring.score(valid.withColumn("text", serving_text("subject", "description")),
                           features, heads, keep=(id_col, "subject", "description", "text", *own_time))
    return io.log_rows(scored, id_col, latency_ms=0.0, ts=F.col(time_col) if own_time else None)


def quarantine_stream(tickets: DataFrame, features: str = "embedding") -> DataFrame:
    """The tickets that ``triage_stream`` does not score, with their reason."""
    return io.validate(tickets, features=features).where(F.col("reject_reason").isNotNull())


def start_committed(log_rows: DataFrame, log: CommitLog, checkpoint: str, name: str = "stream", available_now: bool = True):
    """Exactly-once sink: micro-batch n is batch ``name``-n of the log. A
    batch that was committed before a crash and comes again is skipped."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        log.append(batch, f"{name}-{batch_id}")

    w = log_rows.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def start_triage(log_rows: DataFrame, path: str, checkpoint: str,
                 available_now: bool = True):
    """Replay-safe sink: each micro-batch overwrites its own
    ``batch_id`` partition (dynamic partition overwrite)."""

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(path))

    w = (log_rows.writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
