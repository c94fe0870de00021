"""Review queue (T1, F1, P11) and review state.

Parquet has no row update, so "mark reviewed" appends to an action
table and the current state is the log LEFT JOIN the distinct action
ids. Marking twice changes nothing; unknown ids are reported by an
anti join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.functions import scalar as S
from ticketlens.sources.commit_log import CommitLog

QUEUE_LIMIT = 50
QUEUE_COLUMNS = ("id", "subject", "description", "pred_category", "pred_priority",
                 "pred_sentiment", "confidence", "timestamp")


def apply_review_actions(log: DataFrame, actions: DataFrame) -> DataFrame:
    """Current log state. Action ids are de-duplicated before the
    join (partial aggregation map-side), so repeated marks never
    multiply log rows."""
    marked = actions.select(F.col("ticket_id").alias("id")).distinct() \
        .withColumn("_marked", F.lit(True))
    joined = log.join(marked, "id", "left")
    return joined.withColumn(
        "reviewed", F.coalesce(F.col("reviewed"), F.lit(False)) | F.coalesce(F.col("_marked"), F.lit(False))
    ).drop("_marked")


def unknown_review_ids(log: DataFrame, actions: DataFrame) -> DataFrame:
    """Action ids without a log row (the API answers 404)."""
    ids = actions.select(F.col("ticket_id")).distinct()
    return ids.join(log.select(F.col("id").alias("ticket_id")), "ticket_id", "left_anti")


def lookup(log: DataFrame, ids: DataFrame) -> DataFrame:
    """log rows for a table of ids (semi join; the filter form
    ``where(id == x)`` is pushed to the Parquet scan)."""
    return log.join(ids.select(F.col("ticket_id").alias("id")).distinct(), "id", "left_semi")


def open_items(log: DataFrame) -> DataFrame:
    """flagged and not yet reviewed; null flags drop out."""
    return log.where(F.col("requires_review") & ~F.col("reviewed"))


def review_queue(log: DataFrame, limit: int = QUEUE_LIMIT) -> DataFrame:
    """Newest ``limit`` open items, ties by higher id. Planned as
    TakeOrderedAndProject: each task keeps its own top ``limit``."""
    return (open_items(log).select(*QUEUE_COLUMNS)
            .orderBy(F.col("timestamp").desc(), F.col("id").desc())
            .limit(limit))


def newest_first(log: CommitLog, actions: DataFrame, limit: int = QUEUE_LIMIT) -> tuple[DataFrame, list[str]]:
    """T1 on a log kept by day: (the queue, the days that were read). Days are
    read from the newest back, twice as many each time, until ``limit`` open
    items are certain: rows of older days are older than all of these."""
    days, read, n = log.days(), [], 1
    while True:
        read = days[:n]
        rows = log.read().where(F.col("day") >= F.lit(read[-1])) if read else log.read()
        queue = review_queue(apply_review_actions(rows, actions), limit)
        if n >= len(days) or queue.count() >= limit:
            return queue, read
        n *= 2


def review_queue_export(log: DataFrame, limit: int = QUEUE_LIMIT) -> DataFrame:
    """T1 + P11: the queue as the API returns it (ISO timestamp text)."""
    q = review_queue(log, limit)
    return q.select(*[c for c in QUEUE_COLUMNS if c != "timestamp"],
                    S.iso_timestamp("timestamp").alias("timestamp"))
