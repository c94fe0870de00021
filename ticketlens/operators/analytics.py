"""Prediction-log analytics (A1-A9, A12) and display columns.

The reference runs eight separate statements; here one scan feeds all of
them through GROUPING SETS (Expand + one partial/final hash aggregate),
so the parts of the dashboard come from one snapshot of the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.functions import scalar as S

DIMENSIONS = ("category", "sentiment", "priority", "day")


def kpis(log: DataFrame) -> DataFrame:
    """A1, A5 (flagged, F2), A6 (mean latency), A7 (+P13): one row, zeros
    on an empty log."""
    return log.agg(
        F.count("id").alias("total_tickets"),
        S.py_round(F.coalesce(F.avg("confidence"), F.lit(0.0)), S.CONFIDENCE_PLACES).alias("avg_confidence"),
        S.py_round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), S.LATENCY_PLACES).alias("avg_latency_ms"),
        F.coalesce(F.count_if(F.col("requires_review") == F.lit(True)), F.lit(0)).alias("flagged_for_review"),
    )


def distribution(log: DataFrame, column: str, label: str = "label") -> DataFrame:
    """A2 (category), A3 (sentiment), A4 (priority): (label, n) for one
    predicted column."""
    return log.groupBy(F.col(column).alias(label)).agg(F.count("id").alias("n"))


def priority_distribution(log: DataFrame) -> DataFrame:
    """A4 + P14: priority counts with the display rank."""
    return (distribution(log, "pred_priority", "pred_priority")
            .withColumn("priority_rank", S.priority_rank("pred_priority")))


def daily_counts(log: DataFrame) -> DataFrame:
    """A8 (+P10, T3): tickets per UTC day, ordered by day."""
    return (log.groupBy(S.day_bucket("timestamp").alias("date"))
            .agg(F.count("id").alias("n")).orderBy("date"))


def rollup(log: DataFrame) -> DataFrame:
    """A9 in one pass: GROUPING SETS over category, sentiment, priority,
    day and the grand total. Output rows ``(dimension, label, n,
    sum_confidence, sum_latency_ms, flagged)``; ``dimension = 'all'`` is
    the KPI row (label null)."""
    cols = log.select(
        "id", "confidence", "latency_ms", "requires_review",
        F.col("pred_category").alias("category"),
        F.col("pred_sentiment").alias("sentiment"),
        F.col("pred_priority").alias("priority"),
        S.day_bucket("timestamp").alias("day"),
    )
    g = F.grouping
    return cols.groupingSets(
        [["category"], ["sentiment"], ["priority"], ["day"], []],
        "category", "sentiment", "priority", "day",
    ).agg(
        F.count("id").alias("n"),
        F.sum("confidence").alias("sum_confidence"),
        F.sum("latency_ms").alias("sum_latency_ms"),
        F.count_if(F.col("requires_review") == F.lit(True)).alias("flagged"),
        g("category").alias("_gc"), g("sentiment").alias("_gs"),
        g("priority").alias("_gp"), g("day").alias("_gd"),
    ).select(
        F.when(F.col("_gc") == 0, "category").when(F.col("_gs") == 0, "sentiment")
         .when(F.col("_gp") == 0, "priority").when(F.col("_gd") == 0, "day")
         .otherwise("all").alias("dimension"),
        F.coalesce("category", "sentiment", "priority", "day").alias("label"),
        "n", "sum_confidence", "sum_latency_ms", "flagged",
    )


def rollup_report(log: DataFrame) -> DataFrame:
    """The rollup with rounded means instead of sums (comparison form)."""
    r = rollup(log)
    return r.select(
        "dimension", "label", "n",
        S.py_round(F.coalesce(F.col("sum_confidence") / F.col("n"), F.lit(0.0)), S.CONFIDENCE_PLACES).alias("avg_confidence"),
        S.py_round(F.coalesce(F.col("sum_latency_ms") / F.col("n"), F.lit(0.0)), S.LATENCY_PLACES).alias("avg_latency_ms"),
        F.coalesce(F.col("flagged"), F.lit(0)).alias("flagged"),
    )


def bundle(log: DataFrame) -> DataFrame:
    """The analytics bundle as one nested row, built from the
    one-pass rollup. Maps per dimension, day series sorted by date.
    An empty log gives zeros, empty maps and an empty series."""
    return bundle_of(rollup(log))


def bundle_of(r: DataFrame) -> DataFrame:
    """The bundle of rollup rows."""
    def dist(dim):
        return F.map_from_entries(F.coalesce(
            F.collect_list(F.when(F.col("dimension") == dim, F.struct(F.col("label"), F.col("n")))),
            F.array()))

    series = F.array_sort(F.collect_list(F.when(
        F.col("dimension") == "day", F.struct(F.col("label").alias("date"), F.col("n").alias("count")))))
    total = F.max(F.when(F.col("dimension") == "all", F.col("n")))
    sum_conf = F.max(F.when(F.col("dimension") == "all", F.col("sum_confidence")))
    sum_lat = F.max(F.when(F.col("dimension") == "all", F.col("sum_latency_ms")))
    flagged = F.max(F.when(F.col("dimension") == "all", F.col("flagged")))
    return r.agg(
        F.coalesce(total, F.lit(0)).alias("total_tickets"),
        dist("category").alias("category_dist"),
        dist("sentiment").alias("sentiment_dist"),
        dist("priority").alias("priority_dist"),
        S.py_round(F.coalesce(sum_conf / total, F.lit(0.0)), S.CONFIDENCE_PLACES).alias("avg_confidence"),
        S.py_round(F.coalesce(sum_lat / total, F.lit(0.0)), S.LATENCY_PLACES).alias("avg_latency_ms"),
        F.coalesce(flagged, F.lit(0)).alias("flagged_for_review"),
        series.alias("tickets_over_time"),
    )


def confidence_bands(log: DataFrame) -> DataFrame:
    """Display percent and bands per log row."""
    pct = S.confidence_pct("confidence")
    return log.select(
        "id",
        pct.alias("confidence_pct"),
        S.ticket_band(pct).alias("ticket_band"),
        S.queue_band(pct).alias("queue_band"),
        S.kpi_band(pct).alias("kpi_band"),
    )


def batch_summary(scored: DataFrame) -> DataFrame:
    """Count, mean latency (3 places) and flagged count of a batch."""
    return scored.agg(
        F.count(F.lit(1)).alias("count"),
        S.py_round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), S.LATENCY_PLACES).alias("avg_latency_ms"),
        F.coalesce(F.count_if(F.col("requires_review") == F.lit(True)), F.lit(0)).alias("flagged"),
    )
