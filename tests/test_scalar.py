import datetime as dt
import random

from pyspark.sql import functions as F

from ticketlens.functions import scalar as S


def test_py_round_matches_python(spark):
    random.seed(7)
    vals = [2.675, 0.0625, 35.05, 0.3505 * 100, 0.6345 * 100, 0.125, 1234567.125, 99.95, -2.5]
    vals += [round(random.random(), 4) * 100 for _ in range(500)] + [random.random() for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    for d in (0, 1, 3, 4):
        got = [r[0] for r in df.select(S.py_round("v", d)).collect()]
        assert got == [round(v, d) for v in vals]


def test_py_round_on_ties_and_small_values(spark):
    rng = random.Random(11)
    vals = [0.00005, 0.00015, 0.00025, 5e-05, 1.5e-4, 4.9999999999e-5, 2.5e-5, 1e-9, 5e-324, 0.0, -0.00005, 0.5, 1.5, 2.5, -0.5, -1.5, 0.49999999999999994]
    vals += [(2 * k + 1) / 2 for k in range(-20, 20)] + [k / 1024 for k in range(-300, 300)] + [(2 * rng.randrange(10 ** 6) + 1) / 2 / 10 ** n for n in (1, 3, 4) for _ in range(500)]
    vals += [rng.random() * 10 ** rng.randrange(-8, 17) for _ in range(1000)] + [2.0 ** 52 + 0.5, 2.0 ** 53 + 1, 4503599627370497.5, 1e300, -1e22]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    for d in (0, 1, 3, 4):
        got = [r[0] for r in df.select(S.py_round("v", d)).collect()]
        assert got == [round(v, d) for v in vals]
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "v double").select(S.py_round("v", 2).alias("r")).collect()
    assert odd[0].r is None and odd[1].r != odd[1].r and odd[2].r == float("inf")


def test_review_flag_uses_unrounded_confidence(spark):
    df = spark.createDataFrame([(0.59996,), (0.60,), (0.61,)], "c double")
    rows = df.select(S.py_round("c", 4).alias("stored"), S.review_flag("c").alias("flag")).collect()
    assert [(r.stored, r.flag) for r in rows] == [(0.6, True), (0.6, False), (0.61, False)]


def test_iso_timestamp_two_forms(spark):
    ts = [dt.datetime(2025, 3, 15, 21, 18, 57), dt.datetime(2025, 3, 15, 21, 18, 57, 120)]
    df = spark.createDataFrame([(t,) for t in ts], "ts timestamp")
    got = [r[0] for r in df.select(S.iso_timestamp("ts")).collect()]
    assert got == [t.isoformat() for t in ts]


def test_bands_rank_and_match(spark):
    df = spark.createDataFrame([(0.7549, "High", 0.874), (0.6, "Low", 0.005), (0.4999, "Urgent", 0.0)],
                               "c double, p string, s double")
    pct = S.confidence_pct("c")
    rows = df.select(pct.alias("pct"), S.ticket_band(pct).alias("t"), S.queue_band(pct).alias("q"),
                     S.kpi_band(pct).alias("k"), S.priority_rank("p").alias("r"),
                     S.match_pct("s").alias("m")).collect()
    assert [tuple(r) for r in rows] == [
        (75.5, "green", "amber", "green", 1, 87.0),
        (60.0, "amber", "amber", "amber", 3, 0.0),
        (50.0, "red", "amber", "amber", None, 0.0),
    ]
