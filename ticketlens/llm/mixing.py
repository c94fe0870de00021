"""Operator 8: mixing sources to target weights by pivotal rounding.

A document's size is its number of words. Sources in code-point order
(null last) weigh 5, 2, 1, repeating, and share ``SHARE`` of all sizes by
weight; a target stops at ``MOST`` times its source's size and the excess
is shared again until none is above. A document of a source is taken
target / size times: the whole part is certain, the fraction is rounded by
pairs. Of two fractional documents, words move from one to the other until
one of them is taken wholly or not at all; which way is drawn so that each
keeps its expected number, and the words taken stay the same. One document
with a fraction is left per source and bucket; buckets are merged 64 to
one, level by level, with the same step, and the last one left of a source
is drawn by its fraction. So a source misses its target by less than its
largest document.

Buckets hold about ``BUCKET`` rows by a hash of the row, whatever its
source, so a source with a third of all rows is spread over them; rows of
a bucket are read as a sorted stream. Draws are seeded by level, bucket
and source: a rerun gives the same mix on any cluster.

Defined cases: a null or empty text has size 0 and is never taken; a null
source is a source, the last; a null doc_id is a value; repeated rows are
documents of their own; an empty table gives an empty mix; the other
columns are ignored by ``mix`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import cut, text_or_empty, words

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
BUCKET = 4096
MERGE = 64
SEED = 8
TINY = 1e-9
#: A table of at most so many sources (a few MB) is broadcast; a longer one
#: is joined by a shuffle whose hot partitions are split at run time.
BROADCAST_SOURCES = 50_000


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> tuple[DataFrame, int]:
    """(source, source_size, target) of each source, and their number."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.col("source").asc_nulls_last()
    parts = max(1, int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    ranged = cut(totals.repartitionByRange(parts, order).sortWithinPartitions(order)).withColumn("part", F.spark_partition_id())
    counts = {r.part: r.n for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, at = {}, 0
    for part in sorted(counts):
        before[part], at = at, at + counts[part]
    cycle = list(weights)

    def weigh(batches):
        import pyarrow as pa
        k = None
        for batch in batches:
            if not batch.num_rows:
                continue
            k = before[batch.column(2)[0].as_py()] if k is None else k
            w = [cycle[(k + i) % len(cycle)] for i in range(batch.num_rows)]
            k += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(w, pa.float64())], names=["source", "source_size", "weight"])

    weighed = cut(ranged.mapInArrow(weigh, "source string, source_size long, weight double"))
    full = F.col("source_size") * F.lit(most)
    total = weighed.agg((F.sum("source_size") * F.lit(share)).alias("t")).head().t or 0.0
    # level: words per weight. It only rises, and a source once full stays full.
    level, n_full = 0.0, -1
    while True:
        over = (F.col("weight") * F.lit(level)) > full
        r = weighed.agg(F.sum(F.when(over, full)).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("weight"),
                        F.count(F.when(over, 1)).alias("n")).head()
        if r.n == n_full or not r.weight:
            break
        level, n_full = (total - (r.full or 0.0)) / r.weight, r.n
    return weighed.select("source", "source_size", F.least(full, F.col("weight") * F.lit(level)).alias("target")), at


def pivot(a, x, b, y, draw: float) -> tuple[float, float]:
    """Moves words between documents of sizes a and b taken x and y times
    (both fractions) until one is whole; a*x + b*y and both expectations
    stay."""
    up, down = min(1.0 - x, y * b / a), min(x, (1.0 - y) * b / a)
    if draw * (up + down) < down:
        x, y = x + up, y - up * a / b
    else:
        x, y = x - down, y + down * a / b
    return tuple(0.0 if v < TINY else 1.0 if v > 1.0 - TINY else v for v in (x, y))


def rounded(rows: DataFrame, seed: int, level: int, last: bool) -> DataFrame:
    """One level: within each bucket and source at most one fraction stays
    (none on the last level, which draws it)."""
    names = rows.columns
    at = {c: k for k, c in enumerate(names)}

    def run(batches):
        import pyarrow as pa
        group, held, rng, schema = None, None, None, None

        def settle(row):
            if last:
                row[at["x"]] = 1.0 if rng.random() < row[at["x"]] else 0.0
            return row

        for batch in batches:
            schema, done = batch.schema, []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                row = list(row)
                if (row[at["bucket"]], row[at["source"]]) != group:
                    if held is not None:
                        done.append(settle(held))
                    group, held = (row[at["bucket"]], row[at["source"]]), None
                    rng = random.Random(f"{seed}|{level}|{group!r}")
                if not 0.0 < row[at["x"]] < 1.0:
                    done.append(row)
                elif held is None:
                    held = row
                else:
                    held[at["x"]], row[at["x"]] = pivot(held[at["size"]], held[at["x"]], row[at["size"]], row[at["x"]], rng.random())
                    if 0.0 < held[at["x"]] < 1.0:
                        done.append(row)
                    else:
                        done.append(held)
                        held = row if 0.0 < row[at["x"]] < 1.0 else (done.append(row) or None)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], f.type) for k, f in enumerate(schema)], schema=schema)
        if held is not None:
            row = settle(held)
            yield pa.RecordBatch.from_arrays([pa.array([row[k]], f.type) for k, f in enumerate(schema)], schema=schema)

    dealt = rows.repartition("bucket", "source") if level else rows.repartition("bucket")
    return dealt.sortWithinPartitions("bucket", "source", "key", "doc_id", "size").mapInArrow(run, rows.schema)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, source, key (a hash of the text), size, source_size, target,
    copies, taken of every row."""
    text = text_or_empty("text")
    sizes = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("key"),
                            F.size(words(text)).cast("long").alias("size")))
    of_source, n_sources = targets(sizes, weights, share, most)
    of_source = of_source.withColumnRenamed("source", "s")
    rows = sizes.join(F.broadcast(of_source) if n_sources <= BROADCAST_SOURCES else of_source,
                      sizes.source.eqNullSafe(of_source.s), "left").drop("s")
    buckets = max(1, -(-sizes.count() // BUCKET))
    times = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("times", times).select(
        "doc_id", "source", "key", "size", "source_size", "target", F.floor("times").cast("long").alias("whole"),
        (F.col("times") - F.floor("times")).alias("x"), F.pmod(F.xxhash64("doc_id", "source", "key"), F.lit(buckets)).cast("long").alias("bucket"))
    done, level = None, 0
    while True:
        last = buckets == 1
        out = cut(rounded(rows, seed, level, last))
        part = out if last else out.where("x <= 0 or x >= 1")
        done = part if done is None else done.unionByName(part)
        if last:
            break
        rows = out.where("x > 0 and x < 1").withColumn("bucket", F.floor(F.col("bucket") / MERGE).cast("long"))
        buckets, level = -(-buckets // MERGE), level + 1
    copies = F.col("whole") + F.col("x").cast("long")
    return done.select("doc_id", "source", "key", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents as often as the mix takes them, with their columns.
    Equal rows are numbered, and the n-th takes the n-th count."""
    taken = mix(docs, **options).groupBy("doc_id", "source", "key").agg(F.sort_array(F.collect_list("copies")).alias("copies"))
    names = docs.columns
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").alias("mix_id"),
                      F.col("source").cast("string").alias("mix_source"), F.xxhash64(text_or_empty("text")).alias("mix_key"))
    from pyspark.sql import Window
    equal = Window.partitionBy("mix_id", "mix_source", "mix_key").orderBy(F.xxhash64("row"))
    own = own.withColumn("mix_n", F.row_number().over(equal))
    return own.join(taken, own.mix_id.eqNullSafe(taken.doc_id) & own.mix_source.eqNullSafe(taken.source) & (own.mix_key == taken.key)).select(
        "row", F.explode(F.array_repeat(F.lit(1), F.element_at("copies", F.col("mix_n")).cast("int"))).alias("again")).select("row.*")
