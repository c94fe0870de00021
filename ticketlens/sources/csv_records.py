"""Quoted CSV read in parallel inside one file.

A line break inside quotes is part of its field, so whether a byte range
begins inside quotes depends on all that comes before it. The lines of a
file are read by Spark in byte ranges, and their records are found in two
passes:

1. A range is run from both possible states, outside and inside quotes, and
   gives the state after it for each: one small row per range. Such maps
   compose, so a window per file gives each range its first state: the
   value after the last range that ends in one state whatever it began
   with, flipped as often as the ranges since then flip it.
2. Ranges cut their lines into records, knowing their first state. A record
   over several ranges comes out in pieces, which are joined per file.

A quote opens a field only where the field begins; inside, a doubled quote
is a quote. What is between a closing quote and the next comma belongs to
the field as it is. Line breaks inside quotes are kept; blank lines are
skipped. The header is the first record of each file, and the files' headers
must be equal.

Passes read the file by ranges of ``spark.sql.files.maxPartitionBytes``; no
task holds more than a record and a batch of lines, the driver holds one
header and 8 bytes for each range that begins inside quotes.
"""

from __future__ import annotations

import csv
import io
import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketlens.session import bounded_batches

# The kernels run in Python workers; ship this module's code with the
# closure so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CORRUPT = "_corrupt_record"
#: Quoting of the fields of a record.
OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line that begins inside (outside) quotes ends inside."""
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line[at + 1:at + 2] == '"':
                at += 2
                continue
            inside, at = False, line.find(",", at + 1) + 1
            if not at:
                return False
        if line[at:at + 1] == '"':
            inside, at = True, at + 1
            continue
        at = line.find(",", at) + 1
        if not at:
            return False


def lines(spark: SparkSession, path) -> DataFrame:
    """(file, start, line): physical lines, in order within a range, which a
    task reads in one go."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))


def by_range(batches):
    """(file, start, lines) of each stretch of one range."""
    for batch in batches:
        file, start, text = batch.columns
        name, at = file.to_pylist(), start.to_numpy(zero_copy_only=False)
        text = text.to_pylist()
        begin = 0
        for k in range(1, len(text) + 1):
            if k == len(text) or at[k] != at[begin] or name[k] != name[begin]:
                yield name[begin], int(at[begin]), text[begin:k]
                begin = k


def range_states(rows: DataFrame) -> DataFrame:
    """(file, start, outside, inside): the state after each range, by the
    state before it."""
    def run(batches):
        import pyarrow as pa
        states: dict = {}
        for file, start, text in by_range(batches):
            outside, inside = states.get((file, start), (False, True))
            for line in text:
                if '"' in line:  # any other line ends as it begins
                    outside, inside = ends_inside(line, outside), ends_inside(line, inside)
            states[file, start] = (outside, inside)
        yield pa.RecordBatch.from_pydict({
            "file": pa.array([f for f, _ in states], pa.string()), "start": pa.array([s for _, s in states], pa.int64()),
            "outside": pa.array([o for o, _ in states.values()], pa.bool_()), "inside": pa.array([i for _, i in states.values()], pa.bool_())})

    return rows.mapInArrow(run, "file string, start long, outside boolean, inside boolean")


def first_states(states: DataFrame) -> DataFrame:
    """(file, start, begins_inside) of each range."""
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    flips = F.col("outside") & ~F.col("inside")
    fixed = F.when(F.col("outside") == F.col("inside"), F.col("outside"))  # the same whatever came before
    total = F.sum(flips.cast("int")).over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0))
    run = states.select("file", "start", fixed.alias("fixed"), total.alias("flips"))
    last = F.last(F.when(F.col("fixed").isNotNull(), F.struct("fixed", "flips")), True).over(before)
    after = F.coalesce(F.last("flips").over(before), F.lit(0)) - F.coalesce(last["flips"], F.lit(0))
    return run.select("file", "start", (F.coalesce(last["fixed"], F.lit(False)) != (after % 2 == 1)).alias("begins_inside"))


def place_hash(file, start):
    return F.xxhash64(file, start)


RECORD, LAST, BEGIN, MIDDLE, HEADER = range(5)


def pieces(rows: DataFrame, inside: np.ndarray) -> DataFrame:
    """(file, start, kind, text): whole records, the piece that ends a record
    of an earlier range (LAST), the piece that begins one that goes on in
    the next range (BEGIN), a range inside one record (MIDDLE), and each
    file's first record (HEADER). ``inside`` has the hashes of the ranges
    that begin inside quotes, in order."""
    sent = rows.sparkSession.sparkContext.broadcast(inside)

    def run(batches):
        import pyarrow as pa
        key, held, state, begun, header = None, [], False, False, False  # held: lines of the open record; begun: in this range

        def batch_of(out):
            return pa.RecordBatch.from_pydict({
                "file": pa.array([r[0] for r in out], pa.string()), "start": pa.array([r[1] for r in out], pa.int64()),
                "kind": pa.array([r[2] for r in out], pa.int32()), "text": pa.array([r[3] for r in out], pa.string())})

        def close():
            return [(*key, BEGIN if begun else MIDDLE, "\n".join(held))] if held else []

        for batch in batches:
            out, at, place = [], 0, batch.column(3).to_numpy(zero_copy_only=False)
            for file, start, text in by_range([batch.select([0, 1, 2])]):
                if key != (file, start):
                    out += close()
                    k = np.searchsorted(sent.value, place[at])
                    state = bool(k < len(sent.value) and sent.value[k] == place[at])
                    key, held, begun, header = (file, start), [], not state, start == 0
                at += len(text)
                for line in text:
                    held.append(line)
                    if '"' in line:
                        state = ends_inside(line, state)
                    if not state:
                        record = "\n".join(held)
                        first = header and record.strip("\r") != ""
                        out.append((file, start, HEADER if first else RECORD if begun else LAST, record))
                        held, begun, header = [], True, header and not first
            yield batch_of(out)
        yield batch_of(close())

    return rows.select("file", "start", "line", place_hash("file", "start").alias("place")).mapInArrow(
        run, "file string, start long, kind int, text string")


def joined(parts: DataFrame) -> DataFrame:
    """The texts of the records that were cut by ranges. At most two pieces
    per range are shuffled."""
    order = Window.partitionBy("file").orderBy("start", "kind")
    chain = F.sum((F.col("kind") == BEGIN).cast("int")).over(order)
    return parts.withColumn("chain", chain).groupBy("file", "chain").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "text"))).alias("all")).select(F.array_join(F.col("all.text"), "\n").alias("text"))


def records(spark: SparkSession, path) -> tuple[DataFrame, str]:
    """The records (text) of CSV files without their header, and the header."""
    bounded_batches(spark, rows=8192)
    rows = lines(spark, path)
    firsts = first_states(range_states(rows)).where("begins_inside").select(place_hash("file", "start").alias("place"))
    inside = np.sort(firsts.toArrow().column(0).to_numpy().astype(np.int64))
    parts = pieces(rows, inside).checkpoint()
    headers = parts.where(F.col("kind") == HEADER).groupBy(clean("text").alias("text")).agg(F.count("*").alias("n")).orderBy("text").limit(2).collect()
    if not headers:
        raise ValueError("the file has no header")
    if len(headers) > 1:
        raise ValueError(f"the files have different headers: {headers[0].text!r} and {headers[1].text!r}")
    whole = parts.where(F.col("kind") == RECORD).select("text").unionByName(joined(parts.where(F.col("kind").isin(LAST, BEGIN, MIDDLE))))
    return whole.select(clean("text").alias("text")).where("text <> ''"), headers[0].text


def clean(text: str):
    """Without the line's carriage return and a byte order mark."""
    return F.regexp_replace(text, "^\uFEFF|\r$", "")


def column_names(header: str) -> list[str]:
    """The header's names; empty and repeated ones get their number, as in
    Spark's own reader."""
    names = next(csv.reader(io.StringIO(header, newline="")))
    lower = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if lower.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def read(spark: SparkSession, path) -> DataFrame:
    """Every column as text, by the names of the header, plus the record in
    ``_corrupt_record`` where it does not fit the header. Files with another
    header are an error, as columns would be swapped."""
    rows, header = records(spark, path)
    names = [*column_names(header), CORRUPT]
    ddl = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    return rows.select(F.from_csv("text", ddl, OPTIONS).alias("row")).select(*[F.col("row").getField(n).alias(n) for n in names])
