"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.session import ensure_checkpoint_dir

#: The separators of words: space and U+0009 to U+000D, nothing else.
SPACES = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text in order; a null or empty text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row. Catalyst may
    copy an expression into every place (and every lambda call) that uses
    it; a lambda variable is never copied."""
    return F.transform(F.array(value), body)[0]


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the column as text, modulo n; null for a null value."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(n)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the session's
    ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle(df: DataFrame, part_bytes: int = 4 << 20) -> DataFrame:
    """``cut``, read back by as many tasks as the stored bytes need: a shuffle
    leaves a small table in many files, and each join of such tables would
    start a task for every one of them."""
    out = cut(df)
    rdd = out._jdf.queryExecution().logical().rdd()
    path = out.sparkSession._jvm.org.apache.hadoop.fs.Path(rdd.getCheckpointFile().get())
    size = path.getFileSystem(out.sparkSession._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    parts = max(1, -(-size // part_bytes))
    return out.coalesce(parts) if parts < rdd.getNumPartitions() else out


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bounds the Arrow batches by rows and bytes: a text may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def round_sig(x: float, digits: int = 9) -> float:
    return 0.0 if x == 0 or not math.isfinite(x) else float(f"{x:.{digits}g}")
