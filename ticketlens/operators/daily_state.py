"""Incremental analytics (A9, E4): partial states by day, kept as a table.

A state row is ``(day, dimension, label, n, sum_confidence, sum_latency_ms,
flagged)``: counts and exact decimal sums of the log rows of a day, by
category, sentiment and priority and (dimension ``day``) as a whole. States
merge by addition, so ``refresh`` reads only the batches of the log that the
state does not cover yet and adds their states; late rows change the states
of their own, older days. The bundle is the sum of all states, whatever the
order in which rows came.

A version of the state names its parts and the batches they cover, and is
published by a rename that never replaces a file: a refresh that is killed
changes nothing, and of two at a time the second raises ``Conflict``. Parts
are merged into one when there are more than ``PARTS``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.functions import scalar as S
from ticketlens.operators import analytics
from ticketlens.operators.segments import Conflict
from ticketlens.sources.commit_log import CommitLog, Published

PARTS = 8
EXACT = "decimal(38,16)"
KEYS = ("day", "dimension", "label")
SUMS = ("n", "sum_confidence", "sum_latency_ms", "flagged")


def states(log: DataFrame) -> DataFrame:
    """The states of log rows, from one scan."""
    cols = log.select(
        "id", F.col("confidence").cast(EXACT).alias("confidence"), F.col("latency_ms").cast(EXACT).alias("latency_ms"), "requires_review",
        F.col("pred_category").alias("category"), F.col("pred_sentiment").alias("sentiment"), F.col("pred_priority").alias("priority"),
        S.day_bucket("timestamp").alias("day"))
    g = F.grouping
    sets = cols.groupingSets([["day", "category"], ["day", "sentiment"], ["day", "priority"], ["day"]], "day", "category", "sentiment", "priority").agg(
        F.count("id").alias("n"), F.sum("confidence").cast(EXACT).alias("sum_confidence"), F.sum("latency_ms").cast(EXACT).alias("sum_latency_ms"),
        F.count_if(F.col("requires_review") == F.lit(True)).alias("flagged"), g("category").alias("_c"), g("sentiment").alias("_s"), g("priority").alias("_p"))
    return sets.select(
        "day", F.when(F.col("_c") == 0, "category").when(F.col("_s") == 0, "sentiment").when(F.col("_p") == 0, "priority").otherwise("day").alias("dimension"),
        F.when(F.col("_c") == 0, F.col("category")).when(F.col("_s") == 0, F.col("sentiment")).when(F.col("_p") == 0, F.col("priority")).otherwise(F.col("day")).alias("label"),
        *SUMS)


def merged(rows: DataFrame, keys=KEYS) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS])


class DailyState(Published):
    def version(self) -> dict:
        numbers = [int(n.split(".")[0]) for n in self._names("versions")]
        return self._read(f"versions/{max(numbers):012d}.json") if numbers else {"number": 0, "batches": [], "parts": []}

    def refresh(self, log: CommitLog) -> dict:
        """Takes in what the log has committed since; gives the batches, the
        days and the number of rows that were read."""
        before = self.version()
        fresh = sorted(set(log.batches()) - set(before["batches"]))
        if not fresh:
            return {"batches": [], "days": [], "rows": 0}
        name = uuid.uuid4().hex
        states(log.read_batches(fresh)).write.parquet(f"{self.path}/parts/{name}")
        days = self._read_parts([name]).where("dimension = 'day'").select("day", "n").orderBy("day").collect()
        parts = [*before["parts"], name]
        if len(parts) > PARTS:
            name = uuid.uuid4().hex
            rows = merged(self._read_parts(parts)).select(*KEYS, "n", *[F.col(c).cast(EXACT).alias(c) for c in SUMS[1:3]], "flagged")
            rows.write.parquet(f"{self.path}/parts/{name}")
            parts = [name]
        after = {"number": before["number"] + 1, "batches": sorted({*before["batches"], *fresh}), "parts": parts}
        if not self._publish(f"versions/{after['number']:012d}.json", after):
            raise Conflict(f"version {after['number']} exists")
        return {"batches": fresh, "days": [r.day for r in days], "rows": sum(r.n for r in days)}

    def _read_parts(self, parts: list) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/parts/{p}" for p in parts])

    def rollup(self, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
        """``(dimension, label, n, sum_confidence, sum_latency_ms, flagged)``
        as ``analytics.rollup`` gives them, of all days or of some."""
        parts = self.version()["parts"]
        if not parts:
            return analytics.rollup(CommitLog(self.spark, f"{self.path}/none").read())
        rows = self._read_parts(parts)
        if first_day is not None:
            rows = rows.where(F.col("day") >= first_day)
        if last_day is not None:
            rows = rows.where(F.col("day") <= last_day)
        whole = rows.where("dimension = 'day'").select(F.lit("all").alias("dimension"), F.lit(None).cast("string").alias("label"), *SUMS)
        total = merged(rows.select(*KEYS[1:], *SUMS).unionByName(whole), KEYS[1:])
        return total.select("dimension", "label", "n", *[F.col(c).cast("double").alias(c) for c in SUMS[1:3]], "flagged")

    def bundle(self, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
        """A9 / E4 from the states."""
        return analytics.bundle_of(self.rollup(first_day, last_day))
