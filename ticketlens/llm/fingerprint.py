"""Operator 10: context-triggered piecewise hashing.

A hash of the last seven bytes rolls over the UTF-8 text. Where it hits a
value that occurs once in ``block`` bytes, a piece ends; each piece gives
one of 64 characters. The block size starts at the smallest that leaves at
most ``LONGEST`` pieces expected and halves while the signature is too
short. A fingerprint ``block:pieces:pieces at 2 * block`` is compared with
another at compatible block sizes (equal, or a factor of two apart): the
likeness is 1 - d / (len a + len b) with d the edit distance in insertions
and deletions, and 0 unless the signatures share a run of ``RUN``
characters.

The query needs each document's successor by descending doc_id. Documents
are dealt into ranges of doc_id cut at quantiles (one text shuffle); the
first row of each range also goes to the range before it, so a task reads
its sorted ranges as a stream and holds two rows at a time.

Defined cases: a null text is an empty one, with a fingerprint of no
pieces; null ids come last, equal ids in the order of their texts, and each
repeated row is a row of its own; the successor of the only row is itself;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import small_batches, text_or_empty

WINDOW = 7
SMALLEST = 3
LONGEST = 64
RUN = 7
SEED = 10
RANGES_PER_PARTITION = 4

_rng = np.random.Generator(np.random.PCG64(SEED))
BYTE = _rng.integers(0, 2 ** 32, 256, dtype=np.uint32)
POWERS = [np.uint32(pow(0x9E3779B1, j, 2 ** 32)) for j in range(WINDOW)]
CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def rolling(data: np.ndarray) -> np.ndarray:
    """The hash of the (up to) seven bytes that end at each place."""
    b = BYTE[data]
    h = b.copy()
    for j in range(1, WINDOW):
        h[j:] += b[:-j] * POWERS[j]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return h


def pieces(sums: np.ndarray, ends: np.ndarray, limit: int) -> str:
    """One character per piece; past the limit the rest is one piece."""
    n = len(sums)
    if len(ends) >= limit:
        ends = ends[: limit - 1]
    if not len(ends) or ends[-1] != n - 1:
        ends = np.append(ends, n - 1)
    at = sums[ends]
    values = np.diff(at, prepend=np.uint64(0))
    codes = (values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)
    return "".join([CHARS[c] for c in codes.tolist()])


def fingerprint(text: str) -> str:
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    n = len(data)
    if not n:
        return f"{SMALLEST}::"
    h = rolling(data)
    sums = np.cumsum(h.astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD))
    block = SMALLEST
    while block * LONGEST < n:
        block *= 2
    while True:
        ends = np.flatnonzero(h % np.uint32(block) == block - 1)
        if block == SMALLEST or len(ends) >= LONGEST // 2:
            break
        block //= 2
    twice = ends[h[ends] % np.uint32(2 * block) == 2 * block - 1]
    return f"{block}:{pieces(sums, ends, LONGEST)}:{pieces(sums, twice, LONGEST // 2)}"


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, with a row of the table
    held in the bits of one number."""
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | (1 << k)
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def signature_likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    run = min(RUN, max(1, min(len(a), len(b)) // 2))
    if min(len(a), len(b)) < run or {a[i:i + run] for i in range(len(a) - run + 1)}.isdisjoint(
            b[i:i + run] for i in range(len(b) - run + 1)):
        return 0.0
    return 2 * common_subsequence(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1; fingerprints at incompatible block sizes are unlike."""
    if a == b:
        return 1.0
    (ka, a1, a2), (kb, b1, b2) = a.split(":"), b.split(":")
    ka, kb = int(ka), int(kb)
    if ka == kb:
        return max(signature_likeness(a1, b1), signature_likeness(a2, b2) if a2 and b2 else 0.0)
    if ka == 2 * kb:
        return signature_likeness(a1, b2)
    return signature_likeness(a2, b1) if kb == 2 * ka else 0.0


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def range_number(col: Column, cuts: list) -> Column:
    """How many of the sorted cuts are at most the value: a search in two
    levels, so a row costs twice the root of their number."""
    if not cuts:
        return F.lit(0)
    step = int(len(cuts) ** 0.5) + 1
    blocks = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    firsts, lists = F.array(*[F.lit(b[0]) for b in blocks]), F.array(*[F.array(*[F.lit(x) for x in b]) for b in blocks])
    block = F.size(F.filter(firsts, lambda c: c <= col))
    return F.when(block == 0, F.lit(0)).otherwise(
        (block - 1) * step + F.size(F.filter(F.element_at(lists, F.greatest(block, F.lit(1))), lambda c: c <= col)))


def with_successors(docs: DataFrame) -> DataFrame:
    """doc_id, text and the range a row is dealt to; tail marks the copies
    that only serve as successors."""
    spark = docs.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = parts * RANGES_PER_PARTITION
    cuts = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 100 * n).alias("c")).head().c or []
    number = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(range_number(F.col("doc_id"), sorted(set(cuts))))
    ids = docs.select("doc_id", number.alias("range"))
    first = sorted(((r.range, r.first) for r in ids.groupBy("range").agg(F.max("doc_id").alias("first")).collect()), reverse=True)
    bounds = spark.createDataFrame(
        [(r, f, first[k - 1][0]) for k, (r, f) in enumerate(first)], f"range int, first {docs.schema['doc_id'].dataType.simpleString()}, before int")
    rows = docs.select("doc_id", text_or_empty("text").alias("text"), number.alias("range")).join(F.broadcast(bounds), "range")
    to = F.when(F.col("doc_id").eqNullSafe(F.col("first")), F.array(
        F.struct(F.col("range"), F.lit(0).alias("tail")), F.struct(F.col("before").alias("range"), F.lit(1).alias("tail"))
    )).otherwise(F.array(F.struct(F.col("range"), F.lit(0).alias("tail"))))
    return rows.select("doc_id", "text", F.inline(to)).repartition(parts, "range").sortWithinPartitions(
        "range", "tail", F.col("doc_id").desc_nulls_last(), "text")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next of every row."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        held = None  # the last own row: (range, doc_id, text, fingerprint)
        ids = None
        for batch in batches:
            ids = batch.schema.field("doc_id").type
            out = [[] for _ in range(7)]
            columns = [batch.column(k).to_pylist() for k in ("doc_id", "text", "range", "tail")]
            for doc_id, text, number, tail in zip(*columns):
                if tail and held is None:
                    continue
                mark = fingerprint(text)
                if held is not None and held[0] == number:
                    changed = edited(held[2], text)
                    other = fingerprint(changed)
                    for column, value in zip(out, (
                            held[1], len(held[2]), hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(), held[3], other,
                            likeness(held[3], other), likeness(held[3], mark))):
                        column.append(value)
                held = None if tail else (number, doc_id, text, mark)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (ids, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return with_successors(docs).mapInArrow(
        run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
