"""Operator 3: substring deduplication by De Bruijn compaction.

Every run of ``K`` words is an edge of the De Bruijn graph of the corpus.
A window of ``WINDOW`` words is a path; its edge with the least hash is its
anchor, so equal windows have equal anchors at equal offsets. Neighbouring
windows with one anchor occurrence compact into one path (about 1.4 paths
per 20 words), whose hash and source coordinates stand for all its windows:

1. Paths are counted by anchor (partial counts in each task). An anchor
   that occurs once has no repeated window.
2. Paths are joined with the repeated anchors. Where all paths of an anchor
   are equal, the graph does not branch there and whole paths repeat.
3. Where it branches, the windows of its paths are compared one by one:
   a window repeats if its hash, next to its anchor's, is found twice.
4. Coordinates of repeated paths and windows go back to their documents,
   where the words that they cover are removed.

Windows are judged on the input. A key is an anchor's hash next to a path's
or window's, 128 bits in all, and coordinates tell occurrences apart, so a
document's own repeats count as well.

Hot anchors (a passage in a third of all documents): step 1 sends one row
per task and anchor; the joins of steps 2 and 3 have unique keys on one
side, and adaptive skew joins split the other. The repeated anchors are
broadcast up to ``BROADCAST_ANCHORS`` of them and joined by a shuffle
beyond. Rows that are equal in id and text have the same coordinates, which
are kept once (distinct in each task first), so a document's coordinates
are bounded by its own length.

Defined cases: a null or empty text has no words; texts under ``WINDOW``
words lose nothing; null and equal ids are told apart by 64 bits of the
text, and rows equal in both repeat each other; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import cut, small_batches, text_or_empty
from ticketlens.llm.token_hashes import Runs, gather, list_column, mix, word_hashes

WINDOW = 35
K = 8
BROADCAST_ANCHORS = 2_000_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLACE = np.uint64(0xFFFFFFFF)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Least value of each stretch of ``width`` values."""
    have = 1
    while 2 * have <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return np.minimum(v[:len(v) - (width - have)], v[width - have:]) if have < width else v


def compact(hashes: np.ndarray, sizes: np.ndarray, window: int, k: int):
    """(document number, first window, number of windows, anchor, path hash,
    window hashes, number of each path's first window hash) of the paths."""
    starts = np.cumsum(sizes) - sizes
    counts = np.maximum(0, sizes - window + 1)
    if not counts.sum():
        return None
    runs = Runs(hashes)
    edge = runs.each(k)
    least = sliding_min((edge & ~PLACE) | np.arange(len(edge), dtype=np.uint64), window - k + 1)
    t = gather(starts, counts)
    doc = np.repeat(np.arange(len(sizes)), counts)
    anchor = (least[t] & PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
    n = np.diff(np.append(first, len(t)))
    begin, at = t[first], anchor[first]
    path = runs.at(begin, n + window - 1) ^ mix((at - begin).astype(np.uint64))
    return doc[first], begin - starts[doc[first]], n, edge[at], path, runs.each(window)[t], first


def paths(docs: DataFrame, window: int, k: int, windows: bool) -> DataFrame:
    """anchor, path and, with windows, doc_id, digest, at, n, hashes."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            hashes, sizes = list_column(batch.column(2))
            found = compact(hashes, sizes, window, k)
            if found is None:
                continue
            doc, at, n, anchor, path, each, first = found
            columns = [pa.array(anchor.view(np.int64)), pa.array(path.view(np.int64))]
            if windows:
                offsets = pa.array(np.append(first, len(each)).astype(np.int32))
                columns += [batch.column(0).take(pa.array(doc)), batch.column(1).take(pa.array(doc)), pa.array(at.astype(np.int32)),
                            pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(each.view(np.int64)))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["anchor", "path"] + (["doc_id", "digest", "at", "n", "hashes"] if windows else [])
    schema = "anchor long, path long" + (f", doc_id {kind}, digest long, at int, n int, hashes array<long>" if windows else "")
    return keyed(docs).select("doc_id", "digest", word_hashes(F.col("text")).alias("words")).mapInArrow(run, schema)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text, for equal ids), text."""
    text = text_or_empty("text")
    return docs.select("doc_id", F.xxhash64(text).alias("digest"), text.alias("text"))


def repeated(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, digest, at, n: stretches of n repeated windows from at on."""
    anchors = cut(paths(docs, window, k, False).groupBy("anchor").agg(
        F.count("*").alias("count"), F.min("path").alias("a"), F.max("path").alias("b")
    ).where("count > 1").select("anchor", (F.col("a") != F.col("b")).alias("branches")))
    small = anchors.count() <= BROADCAST_ANCHORS
    found = cut(paths(docs, window, k, True).join(F.broadcast(anchors) if small else anchors, "anchor").select(
        "anchor", "doc_id", "digest", "at", "n", F.when(F.col("branches"), F.col("hashes")).alias("hashes")))
    whole = found.where("hashes is null").select("doc_id", "digest", "at", "n")
    single = found.where("hashes is not null").select("anchor", "doc_id", "digest", F.inline(
        F.transform("hashes", lambda h, i: F.struct(h.alias("hash"), (F.col("at") + i).alias("at")))))
    # a table of its own: only then can the join's hot partitions be split
    twice = cut(single.groupBy("anchor", "hash").agg(F.count("*").alias("count")).where("count > 1").select("anchor", "hash"))
    part = single.join(twice, ["anchor", "hash"]).select("doc_id", "digest", "at", F.lit(1).alias("n"))
    return whole.unionByName(part)


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words that stay,
    joined by one space) of every row."""
    small_batches(docs.sparkSession)
    spans = repeated(docs, window, k).groupBy(F.col("doc_id").alias("of_id"), F.col("digest").alias("of_digest")).agg(
        F.collect_set(F.shiftleft(F.col("at").cast("long"), 32) + F.col("n")).alias("spans"))  # two numbers in one: half the bytes
    own = keyed(docs)
    rows = own.join(spans, own.doc_id.eqNullSafe(F.col("of_id")) & (own.digest == F.col("of_digest")), "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            n_words, n_removed, digests, kept = [], [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2)):
                words = WORD.findall(text)
                n = len(words)
                if spans.is_valid:
                    pairs = spans.values.to_numpy()
                    at = pairs >> 32
                    end = at + (pairs & 0xFFFFFFFF) + window - 1
                    depth = np.bincount(at, minlength=n + 1) - np.bincount(end, minlength=n + 1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(depth[:n]) == 0).tolist()]
                out = " ".join(words)
                n_words.append(n)
                n_removed.append(n - len(words))
                digests.append(hashlib.sha256(out.encode("utf-8", "replace")).hexdigest())
                kept.append(out)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")
