"""Operator 12: hard negatives by threshold joins over an inverted index.

For each anchor the positives are its ``POSITIVES`` best other rows of the
same label; for each positive the negatives are the best ``NEGATIVES`` rows
of other labels whose score lies between ``SHARE`` per cent of the
positive's and the positive's own. Both are threshold joins in the manner
of L2AP, over blocks of rows and blocks of anchors:

1. The dimensions of a block are ordered by their weight. A row is indexed
   in its leading dimensions only; those behind the place where its suffix
   norm times the largest anchor norm drops below the threshold are
   omitted, as they alone can't lift a score to it.
2. Scores are accumulated over the posting lists, some dimensions at a time.
   A pair goes as soon as its partial score plus the product of both
   remaining norms is below the anchor's threshold.
3. Pairs that are left get their omitted dimensions. Scores are exact whole
   numbers; only the bounds are floats, with a slack.
4. Thresholds start high and are lowered for the anchors whose windows are
   not full yet, until they are, or nothing is left below.

A block keeps at most as many rows per anchor and window as the window
holds, so a vector that a third of all rows share gives no more rows than
any other. Blocks are dealt by a hash of a row number; their sizes, and so
a task's memory, are bounded. Anchors are a stated share of all rows, so
all blocks meet all anchors; with n rows and m anchors n * m / ``ANCHORS``
+ n * m / ``ROWS`` rows are shuffled in a round.

Defined cases: rows with a null label, a null vector or any null or
non-finite component take no part; vectors of different lengths are filled
with zeros; components are held to +-``LIMIT`` after scaling, so that
scores of up to 64 components are exact; equal rows are rows of their own
(a row is never its own positive); null vec_ids are no anchors, keep their label and
come last among equal scores; a label without other rows gives no
positives; a positive with a score below 0 has no negatives; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.llm.centroid_clustering import finite, whole
from ticketlens.llm.common import cut

SCALE = 256
LIMIT = 1 << 23
EVERY = 100
POSITIVES, NEGATIVES = 5, 5
SHARE = 80
#: Thresholds of the positives, as shares of the anchor's norm times the
#: mean norm of rows; None is no threshold.
LADDER = (0.5, 0.35, 0.2, None)
#: Floors of the negatives' windows in per cent of the positive's score,
#: above the last one, SHARE.
FLOORS = (95,)
ROWS, ANCHORS = 16384, 4096
STEP = 8  # dimensions accumulated between two prunings
GROUP = 128  # anchors scored at once


def participants(vectors: DataFrame) -> DataFrame:
    """uid (of the row), vec_id, label, x, norm, anchor."""
    v, label = F.col("embedding"), F.col("label").cast("long")
    part = vectors.where(label.isNotNull() & v.isNotNull() & F.forall(v, finite)).select(
        F.monotonically_increasing_id().alias("uid"), "vec_id",
        F.when(F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), (label + 1) % 10).otherwise(label).alias("label"), whole(v, SCALE, LIMIT).alias("x"))
    return part.select(
        "*", F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, e: s + e.cast("double") * e)).alias("norm"),
        F.coalesce(F.col("vec_id") % EVERY == 0, F.lit(False)).alias("anchor"))


def padded(column, width: int) -> np.ndarray:
    """Rows of an Arrow list column as a matrix, filled with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = values
    return out


def tails(x: np.ndarray) -> np.ndarray:
    """Norms of the components from each place on (and 0 at the end), a
    little too large, as they serve as bounds."""
    squares = np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1]
    return np.concatenate([np.sqrt(squares), np.zeros((len(x), 1))], axis=1) * (1 + 1e-9)


class Index:
    """The rows of a block by dimension, without the dimensions that suffix
    norms cover at a threshold."""

    def __init__(self, x: np.ndarray, least: float, most_norm: float):
        self.order = np.argsort(-(x * x).sum(axis=0), kind="stable")
        self.x = x[:, self.order]
        self.tail = tails(self.x)
        # a row has postings in its first ``indexed`` dimensions
        self.indexed = (self.tail[:, :-1] * most_norm + 1 >= least).sum(axis=1)

    def postings(self, k: int) -> np.ndarray:
        return np.flatnonzero(self.indexed > k)

    def pairs(self, q: np.ndarray, floors: np.ndarray):
        """(anchor, row, score) of all pairs with the anchor's floor or more."""
        q = q[:, self.order]
        if not np.isfinite(floors).all():  # without a threshold nothing can be left out
            score = q @ self.x.T
            a, r = np.nonzero(score >= floors[:, None])
            return a, r, score[a, r]
        width, tail = q.shape[1], tails(q)
        score, reach = np.zeros((len(q), len(self.x))), np.zeros(len(self.x), dtype=np.int64)
        alive, k = np.arange(len(self.x)), 0
        while k < width:  # posting lists, as long as many pairs live
            end = min(width, k + STEP)
            rows = alive[self.indexed[alive] > k]
            score[:, rows] += q[:, k:end] @ self.x[rows, k:end].T
            reach[rows] = end
            k = end
            if not len(rows) or k * 2 >= width:
                break
            rest = score[:, rows] + tail[:, k, None] * self.tail[rows, k]
            gone = rows[~(rest + 1 >= floors[:, None]).any(axis=0)]
            reach[gone] = -1
            alive = np.setdiff1d(alive, gone, assume_unique=True)
        rows = np.flatnonzero((reach >= 0))
        bound = score[:, rows] + tail[:, reach[rows]] * self.tail[rows, reach[rows]]
        a, at = np.nonzero(bound + 1 >= floors[:, None])
        r = rows[at]
        value, done = score[a, r], reach[r]
        for k in range(0, width, STEP):  # what is left of single pairs, pruned as they go
            open_ = np.flatnonzero(done == k)
            end = min(width, k + STEP)
            value[open_] += np.einsum("nd,nd->n", q[a[open_], k:end], self.x[r[open_], k:end])
            done[open_] = end
            keep = value + tail[a, done] * self.tail[r, done] + 1 >= floors[a]
            a, r, value, done = a[keep], r[keep], value[keep], done[keep]
        keep = value >= floors[a]
        return a[keep], r[keep], value[keep]


def first(group: np.ndarray, score: np.ndarray, missing: np.ndarray, ids: np.ndarray, uid: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Places of the best ``most[group]`` of each group: by score, then by id."""
    order = np.lexsort((uid, ids, missing, -score, group))
    g = group[order]
    start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return order[rank < most[g]]


def search(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int) -> DataFrame:
    """(uid_a, high, uid, vec_id, score): the best rows of each block for
    each window of each anchor. ``anchors`` have uid, label, x, norm and
    windows: structs (low, high, most, same): the scores from low to high, how
    many of the best, and whether they have the anchor's label."""
    spark = rows.sparkSession
    blocks = max(-(-n_rows // ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // 256)))
    groups = -(-n_anchors // ANCHORS)
    kind = rows.schema["vec_id"].dataType.simpleString()
    window = "array<struct<low:double,high:double,most:int,same:boolean>>"
    row, column = F.pmod(F.xxhash64("uid"), F.lit(blocks)), F.pmod(F.xxhash64("uid"), F.lit(groups))

    def spread(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    base = ["uid", "vec_id", "label", "x"]
    left = rows.select(*base, row.alias("block"), F.lit(None).cast(window).alias("windows"), spread(groups).alias("part"))
    right = anchors.select("uid", F.lit(None).cast(kind).alias("vec_id"), "label", "x", column.alias("part"), F.col("windows").cast(window).alias("windows"), spread(blocks).alias("block"))

    def run(table):
        import pyarrow as pa
        import pyarrow.compute as pc
        mask = table.column("windows").is_null()
        own, asked = table.filter(mask).combine_chunks(), table.filter(pc.invert(mask)).combine_chunks()
        found = [[], [], [], []]
        if len(own) and len(asked):
            width = max(pc.max(pc.list_value_length(table.column("x"))).as_py(), 1)
            x, q = (padded(t.column("x").combine_chunks(), width) for t in (own, asked))
            uid, label = own.column("uid").to_numpy(), own.column("label").to_numpy()
            missing, ids = own.column("vec_id").is_null().to_numpy(), own.column("vec_id").fill_null(0).to_numpy()
            uid_q, label_q = asked.column("uid").to_numpy(), asked.column("label").to_numpy()
            windows = asked.column("windows").to_pylist()
            floors = np.array([min(w["low"] for w in ws) for ws in windows])
            none = {"low": np.inf, "high": -np.inf, "most": 0, "same": False}
            wide = [[ws[j] if j < len(ws) else none for ws in windows] for j in range(max(map(len, windows)))]
            wide = [[np.array([w[k] for w in ws]) for k in none] for ws in wide]
            index = Index(x, floors.min(), float(np.sqrt((q * q).sum(axis=1)).max()))
            for g in range(0, len(q), GROUP):
                a, r, score = index.pairs(q[g:g + GROUP], floors[g:g + GROUP])
                a = a + g
                keep = uid_q[a] != uid[r]
                a, r, score = a[keep], r[keep], score[keep]
                for low, high, most, same in wide:
                    fits = np.flatnonzero((score >= low[a]) & (score <= high[a]) & ((label_q[a] == label[r]) == same[a]))
                    at = fits[first(a[fits], score[fits], missing[r[fits]], ids[r[fits]], uid[r[fits]], most)]
                    for out, values in zip(found, (uid_q[a[at]], high[a[at]], r[at], score[at])):
                        out.append(values)
        ua, hi, r, s = [np.concatenate(f) if f else np.zeros(0) for f in found]
        r = pa.array(r.astype(np.int64))
        return pa.table([pa.array(ua.astype(np.int64)), pa.array(hi.astype(np.float64)), own.column("uid").take(r), own.column("vec_id").take(r), pa.array(s.astype(np.int64))],
                        names=["uid_a", "high", "uid", "vec_id", "score"])

    return left.unionByName(right).groupBy("block", "part").applyInArrow(run, f"uid_a long, high double, uid long, vec_id {kind}, score long")


def best(found: DataFrame, n: int) -> DataFrame:
    """The first n rows of each (anchor, window) over all blocks, with rank."""
    order = Window.partitionBy("uid_a", "high").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def window_of(low: Column, high: Column, most: Column, same: bool) -> Column:
    return F.struct(low.cast("double").alias("low"), high.cast("double").alias("high"), most.cast("int").alias("most"), F.lit(same).alias("same"))


def positives(rows: DataFrame, anchors: DataFrame, n_rows: int) -> DataFrame:
    """(uid_a, uid, vec_id, score) of the positives of all anchors."""
    counts = rows.groupBy("label").agg(F.count("*").alias("others"))
    open_ = cut(anchors.join(counts, "label").select(
        "uid", "label", "x", "norm", F.least(F.col("others") - 1, F.lit(POSITIVES)).cast("int").alias("want")).where("want > 0"))
    mean = rows.agg(F.avg("norm")).first()[0] or 0.0
    out = None
    for share in LADDER:
        n = open_.count()
        if not n:
            break
        low = F.lit(float("-inf")) if share is None else F.col("norm") * (share * mean)
        asked = open_.withColumn("windows", F.array(window_of(low, F.lit(float("inf")), F.col("want"), True)))
        found = cut(best(search(rows, asked, n_rows, n), POSITIVES).select("uid_a", "uid", "vec_id", "score"))
        full = open_.join(found.groupBy(F.col("uid_a").alias("uid")).agg(F.count("*").alias("n")), "uid").where("n >= want").select("uid")
        full = cut(full)
        part = found.join(full.withColumnRenamed("uid", "uid_a"), "uid_a", "left_semi")
        out = part if out is None else out.unionByName(part)
        open_ = cut(open_.join(full, "uid", "left_anti"))
    return out


def negatives(rows: DataFrame, anchors: DataFrame, chosen: DataFrame, n_rows: int) -> DataFrame:
    """(uid_a, positive_score, rank, uid, vec_id, score) of the negatives of
    each anchor and positive score."""
    open_ = cut(chosen.where("score >= 0").select("uid_a", F.col("score").alias("high")).distinct())
    out = None
    for floor in (*FLOORS, SHARE):
        low = F.ceil(F.col("high") * floor / 100)  # scores are whole: low <= score as floor * high <= 100 * score
        asked = open_.groupBy(F.col("uid_a").alias("uid")).agg(F.collect_list(window_of(low, F.col("high"), F.lit(NEGATIVES), False)).alias("windows"))
        asked = cut(anchors.select("uid", "label", "x", "norm").join(asked, "uid"))
        n = asked.count()
        if not n:
            break
        found = cut(best(search(rows, asked, n_rows, n), NEGATIVES).select("uid_a", F.col("high").cast("long").alias("high"), "rank", "uid", "vec_id", "score"))
        full = cut(found.groupBy("uid_a", "high").agg(F.count("*").alias("n")).where((F.col("n") >= NEGATIVES) | F.lit(floor == SHARE)).select("uid_a", "high"))
        part = found.join(full, ["uid_a", "high"], "left_semi")
        out = part if out is None else out.unionByName(part)
        open_ = cut(open_.join(full, ["uid_a", "high"], "left_anti"))
    return out


def mine(vectors: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = cut(participants(vectors))
    anchors = rows.where("anchor")
    n_rows = rows.count()
    chosen = positives(rows, anchors, n_rows) if n_rows else None
    found = negatives(rows, anchors, chosen, n_rows) if chosen is not None else None
    if found is None:
        return rows.where("false").select(
            F.col("vec_id").alias("anchor_id"), F.col("vec_id").alias("positive_id"), F.lit(0).alias("rank"), F.col("vec_id").alias("negative_id"),
            F.lit(0).cast("long").alias("positive_score"), F.lit(0).cast("long").alias("negative_score"))
    pairs = chosen.select("uid_a", F.col("vec_id").alias("positive_id"), F.col("score").alias("high"))
    ids = anchors.select(F.col("uid").alias("uid_a"), F.col("vec_id").alias("anchor_id"))
    return found.join(pairs, ["uid_a", "high"]).join(ids, "uid_a").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        F.col("high").alias("positive_score"), F.col("score").alias("negative_score"))
