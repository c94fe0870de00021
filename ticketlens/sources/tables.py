"""Adapters from the driver's parquet tables to the ticket data model.

The driver tables hold no support tickets, so every query reads them
through these views (see FIXTURES.md section 3). Every view reads its
whole source table; nothing is sampled, capped or filtered by id.

Deviations from FIXTURES.md, on purpose:
* ``subject`` is the document's ``source`` column, not a prefix of its
  text, so texts are always processed whole.
* the log's ``reviewed`` flag starts False and is set by applying the
  review-action table (the reference's own semantics), instead of a
  modulo rule.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.functions.scalar import py_round

# Fixed values of the adapters (FIXTURES.md section 3).
PRIORITY_HIGH_CHARS = 4000
PRIORITY_MEDIUM_CHARS = 1000
LOG_PRIORITY_HIGH_VALUE = 60.0
LOG_PRIORITY_MEDIUM_VALUE = 20.0
CONFIDENCE_SCALE = 50.0
REVIEW_THRESHOLD = 0.60
MAX_BROADCAST_IDS = 500_000
UNKNOWN_ID_OFFSET = 1_000_000_000
PRIORITY_BY_GROUP = ["High", "Medium", "Low"]          # label % 3
SENTIMENT_BY_GROUP = ["Negative", "Neutral", "Positive"]  # label // 4


def version(spark: SparkSession, *paths: str) -> str:
    """A digest of the names, sizes and times of the tables' files, as the
    path's own file system gives them: equal as long as the data is."""
    seen = []
    for path in paths:
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True)
        while files.hasNext():
            f = files.next()
            seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.md5("\n".join(sorted(seen)).encode()).hexdigest()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents LEFT JOIN labels -> canonical ticket frame (P17: projection
    and rename)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    d = docs.join(labels, "doc_id", "left")
    return d.select(
        F.col("doc_id").alias("ticket_id"),
        F.col("source").alias("subject"),
        F.col("text").alias("description"),
        F.col("lang").alias("category"),
        F.when(F.col("n_chars") >= PRIORITY_HIGH_CHARS, "High")
         .when(F.col("n_chars") >= PRIORITY_MEDIUM_CHARS, "Medium")
         .otherwise("Low").alias("priority"),
        F.when(F.col("toxic") == 1, "Negative")
         .when(F.col("quality") == 1, "Positive")
         .otherwise("Neutral").alias("sentiment"),
    )


def ticket_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``tickets`` with the columns of the documents only. A
    document comes once for each of its rows in labels, so the labels count
    only where an id has several; these ids are few and broadcast, and no
    text is shuffled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    several = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count("*").alias("copies")).where("copies > 1 and doc_id is not null")
    n = several.limit(MAX_BROADCAST_IDS + 1).count()
    if n:
        several = F.broadcast(several) if n <= MAX_BROADCAST_IDS else several
        docs = docs.join(several, "doc_id", "left").withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.coalesce(F.col("copies"), F.lit(1)).cast("int"))))
    return docs.select(F.col("doc_id").alias("ticket_id"), F.col("source").alias("subject"), F.col("text").alias("description"), F.col("lang").alias("category"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> prediction log (``reviewed`` False until actions apply)."""
    ev = table(spark, sf_dir, "events")
    raw_conf = F.lit(CONFIDENCE_SCALE) / (F.col("value") + F.lit(CONFIDENCE_SCALE))
    return ev.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("subject"),
        F.col("props").alias("description"),
        F.col("event_type").alias("pred_category"),
        F.when(F.col("value") >= LOG_PRIORITY_HIGH_VALUE, "High")
         .when(F.col("value") >= LOG_PRIORITY_MEDIUM_VALUE, "Medium")
         .otherwise("Low").alias("pred_priority"),
        F.when(F.col("event_type") == "error", "Negative")
         .when(F.col("event_type") == "purchase", "Positive")
         .otherwise("Neutral").alias("pred_sentiment"),
        py_round(raw_conf, 4).alias("confidence"),
        py_round(F.col("value"), 3).alias("latency_ms"),
        (raw_conf < F.lit(REVIEW_THRESHOLD)).alias("requires_review"),
        F.lit(False).alias("reviewed"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


def review_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review marks: every click marks log id ``user_id`` (ids repeat on
    purpose); every view event carries an id beyond the log (unknown)."""
    ev = table(spark, sf_dir, "events")
    known = ev.where(F.col("event_type") == "click").select(
        F.col("user_id").alias("ticket_id"), F.col("ts").cast("timestamp").alias("action_ts"))
    unknown = ev.where(F.col("event_type") == "view").select(
        (F.col("event_id") + F.lit(UNKNOWN_ID_OFFSET)).alias("ticket_id"),
        F.col("ts").cast("timestamp").alias("action_ts"))
    return known.unionByName(unknown)


def embedded_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tickets with their precomputed sentence embedding, null where
    there is none: the embeddings table joined on ``vec_id = ticket_id``.

    The three targets are derived from the embedding's class so that heads
    and metrics have true labels to compare with.
    """
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ticket_id"), F.col("embedding"), *label_targets(F.col("label")))
    t = tickets(spark, sf_dir).select("ticket_id", "subject", "description")
    return t.join(e, "ticket_id", "left")


def dirty_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets with missing, empty and blank subjects (FIXTURES.md section
    3), for the row validation; every ninth also has no category."""
    t, k = tickets(spark, sf_dir), F.col("ticket_id")
    subject = (F.when(k % 7 == 0, F.lit(None).cast("string")).when(k % 11 == 0, "").when(k % 13 == 0, " ").otherwise(F.col("subject")))
    return t.withColumn("subject", subject).withColumn("category", F.when(k % 9 != 0, F.col("category")))


def evaluation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target, y, yhat) with wrong and never-true predictions (FIXTURES.md
    section 3): y is the priority, yhat is Low for every third ticket and
    Urgent for every fiftieth, else y."""
    k = F.col("ticket_id")
    return tickets(spark, sf_dir).select(
        F.lit("priority").alias("target"), F.col("priority").alias("y"),
        F.when(k % 3 == 0, "Low").when(k % 50 == 1, "Urgent").otherwise(F.col("priority")).alias("yhat"))


def label_targets(label):
    """Embedding class -> (category, priority, sentiment) true labels."""
    return [
        label.cast("string").alias("category"),
        F.element_at(F.array(*[F.lit(x) for x in PRIORITY_BY_GROUP]),
                     (F.pmod(label, F.lit(3)) + 1).cast("int")).alias("priority"),
        F.element_at(F.array(*[F.lit(x) for x in SENTIMENT_BY_GROUP]),
                     (F.floor(label / 4) + 1).cast("int")).alias("sentiment"),
    ]


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings table with its three derived true labels."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id"), F.col("embedding"), *label_targets(F.col("label")))


def query_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New tickets for the similar-ticket lookup: the benchmark passages
    (whole table), with an empty subject."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"),
                    F.lit("").alias("subject"),
                    F.col("text").alias("description"))
