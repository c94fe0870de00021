"""Scalar column rules of the serving and UI layers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the reference's thresholds and display rules.
REVIEW_THRESHOLD = 0.60          # confidence < 0.60 -> requires review
CONFIDENCE_PLACES = 4
SCORE_PLACES = 4
LATENCY_PLACES = 3
TICKET_BAND_HIGH = 75.0          # percent: >= 75 green, >= 60 amber, else red
TICKET_BAND_MID = 60.0
QUEUE_BAND_MID = 50.0            # percent: >= 50 amber, else red
KPI_BAND_HIGH = 75.0             # percent: >= 75 green, else amber
PRIORITY_ORDER = ["High", "Medium", "Low"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _halves(a):
    """A number as the sum of two that have half its digits each."""
    c = a * 134217729.0  # 2^27 + 1
    high = c - (c - a)
    return high, a - high


def py_round(c, places: int) -> Column:
    """Round like Python's ``round(x, n)`` on a float: the exact binary
    value, half to even. Spark's ``round`` rounds the shortest decimal
    form half-up (35.05 -> 35.1, Python gives 35.0). The product with
    10^n is taken without error, as a float and what it lacks; the second
    part decides where the first is a tie. Values that have no fraction
    after scaling stay as they are."""
    x, scale = _col(c), float(10 ** places)
    product = x * F.lit(scale)
    (high, low), (scale_high, scale_low) = _halves(x), _halves(scale)
    lacks = ((high * F.lit(scale_high) - product) + high * F.lit(scale_low) + low * F.lit(scale_high)) + low * F.lit(scale_low)
    below = F.floor(product)
    over = product - below - F.lit(0.5)
    up = (over > 0) | ((over == 0) & ((lacks > 0) | ((lacks == 0) & (below % 2 != 0))))
    return F.when(F.abs(product) < F.lit(2.0 ** 53), (below + up.cast("long")) / F.lit(scale)).otherwise(x)


def review_flag(raw_confidence) -> Column:
    """P5: flag on the unrounded confidence, strictly below 0.60."""
    return _col(raw_confidence) < F.lit(REVIEW_THRESHOLD)


def confidence_pct(conf) -> Column:
    """Confidence as a percent with one decimal."""
    return py_round(_col(conf) * 100, 1)


def ticket_band(pct) -> Column:
    """Single-ticket confidence band."""
    p = _col(pct)
    return (F.when(p >= TICKET_BAND_HIGH, "green")
            .when(p >= TICKET_BAND_MID, "amber").otherwise("red"))


def queue_band(pct) -> Column:
    """Review-queue confidence band."""
    return F.when(_col(pct) >= QUEUE_BAND_MID, "amber").otherwise("red")


def kpi_band(pct) -> Column:
    """Dashboard KPI band of the mean confidence."""
    return F.when(_col(pct) >= KPI_BAND_HIGH, "green").otherwise("amber")


def day_bucket(ts) -> Column:
    """P10: ``yyyy-MM-dd`` in the session time zone (UTC)."""
    return F.date_format(_col(ts), "yyyy-MM-dd")


def iso_timestamp(ts) -> Column:
    """Python ``datetime.isoformat()``; the fraction is omitted when
    the microseconds are zero."""
    t = _col(ts)
    micros = F.pmod(F.unix_micros(t), F.lit(1_000_000))
    return (F.when(micros == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"))
            .otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")))


def match_pct(score) -> Column:
    """Similarity score as a whole percent."""
    return py_round(_col(score) * 100, 0)


def priority_rank(label) -> Column:
    """High 1, Medium 2, Low 3; other labels sort last (null)."""
    c = _col(label)
    expr = None
    for i, name in enumerate(PRIORITY_ORDER, start=1):
        expr = (F.when(c == name, i) if expr is None else expr.when(c == name, i))
    return expr
