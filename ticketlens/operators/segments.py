"""Stored TF-IDF index that grows by segments.

A version of the index is a list of immutable segments, oldest first. A
segment has the postings of its own documents, those of one term of a batch
in one row (term, n, ids, tfs), the ids that it takes out of older segments
(``gone``; up to ``MAX_BROADCAST_IDS`` of them are broadcast to the postings),
and what both change in the document frequencies (``df``: term, change). So a change of some documents
writes about as much as these documents have:

* ``add`` counts the terms of the new texts only;
* ``remove`` reads the postings of the removed ids and writes their
  frequencies with a minus; ``replace`` does both in one version.

Vocabulary and weights are finished when they are read: frequencies are
summed over the segments (partial sums first), pruned and turned into idf;
weights and norms follow from the postings that are left. The rows are those
of an index built anew from the same documents.

Segments of a like size are merged in tiers: ``FANOUT`` neighbours of one
level become one of the next, so the number of segments grows with the
logarithm of the documents and a document is rewritten as often. A version
is published by a rename that never replaces a file; of two writers the
second raises ``Conflict`` and leaves the index as it is. Files of versions
that are no longer read are removed by ``vacuum``.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.operators import tfidf
from ticketlens.sources.commit_log import Published

FANOUT = 4
MAX_BROADCAST_IDS = 1_000_000  # 16 bytes each


class Conflict(RuntimeError):
    """Another writer has published a version meanwhile."""


def _unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("term", F.explode(F.arrays_zip("ids", "tfs")).alias("x")).select(F.col("x.ids").alias("id"), "term", F.col("x.tfs").alias("tf"))


def _single(postings: DataFrame) -> DataFrame:
    return postings.select("term", F.lit(1).cast("long").alias("n"), F.array("id").alias("ids"), F.array("tf").alias("tfs"))


class SegmentedIndex(Published):
    def __init__(self, spark: SparkSession, path: str, min_df: int = tfidf.MIN_DF, max_df: float = tfidf.MAX_DF):
        super().__init__(spark, path)
        self.min_df, self.max_df = min_df, max_df

    # -- versions ---------------------------------------------------------------

    def version(self) -> dict:
        numbers = [int(n.split(".")[0]) for n in self._names("versions")]
        return self._read(f"versions/{max(numbers):012d}.json") if numbers else {"number": 0, "n_docs": 0, "segments": []}

    def _commit(self, before: dict, segments: list, n_docs: int) -> dict:
        after = {"number": before["number"] + 1, "n_docs": n_docs, "segments": segments}
        if not self._publish(f"versions/{after['number']:012d}.json", after):
            raise Conflict(f"version {after['number']} exists")
        return after

    def _part(self, segment: dict, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/segments/{segment['name']}/{name}")

    def _gone(self, segment: dict) -> DataFrame:
        ids = self._part(segment, "gone")
        return F.broadcast(ids) if segment["gone"] <= MAX_BROADCAST_IDS else ids

    def _rows(self, segments: list) -> DataFrame | None:
        """The stored rows that later ones of the segments have not taken out."""
        out, later = None, []
        for s in reversed(segments):
            if s["docs"]:
                rows = self._part(s, "postings")
                if any(t["gone"] for t in later):
                    rows = _unpacked(rows)
                    for t in later:
                        if t["gone"]:
                            rows = rows.join(self._gone(t), "id", "left_anti")
                    rows = _single(rows)
                out = rows if out is None else out.unionByName(rows)
            later = [s, *later]
        return out

    def _live(self, segments: list) -> DataFrame | None:
        """The postings (id, term, tf) that later segments have not taken out."""
        rows = self._rows(segments)
        return None if rows is None else _unpacked(rows)

    # -- writers ----------------------------------------------------------------

    def _write(self, postings: DataFrame | None, n_docs: int, gone: DataFrame | None, minus: DataFrame | None) -> dict:
        """A segment of new rows of postings and removed ids (``minus``: the
        removed ids' postings)."""
        name = uuid.uuid4().hex
        at = f"{self.path}/segments/{name}"
        changes = []
        if postings is not None:
            postings.write.parquet(f"{at}/postings")
            changes.append(self.spark.read.parquet(f"{at}/postings").where("term is not null").groupBy("term").agg(F.sum("n").alias("df")))
        n_gone = 0
        if gone is not None:
            gone.write.parquet(f"{at}/gone")
            n_gone = self.spark.read.parquet(f"{at}/gone").count()
            if minus is not None:
                changes.append(minus.groupBy("term").agg((-F.count("*")).alias("df")))
        df = changes[0] if len(changes) == 1 else changes[0].unionByName(changes[1]).groupBy("term").agg(F.sum("df").alias("df"))
        df.where("df <> 0").write.parquet(f"{at}/df")
        return {"name": name, "docs": n_docs, "gone": n_gone, "level": int(math.log(max(1, n_docs + n_gone), FANOUT))}

    def _ids(self, segments: list, ids: DataFrame) -> DataFrame | None:
        """The postings of the ids (a checkpoint)."""
        rows = self._live(segments)
        few = ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
        return None if rows is None else rows.join(F.broadcast(ids) if few else ids, "id", "left_semi")

    def replace(self, docs: DataFrame | None, id_col: str = "id", text_col: str = "text", ids: DataFrame | None = None) -> dict:
        """Takes the ids out, puts the documents in and publishes the version.
        Documents whose id is in the index must be among the ids."""
        before = self.version()
        segments, n_docs, n_new = before["segments"], before["n_docs"], 0
        postings = None
        if docs is not None:
            n_new = docs.select(id_col).count()
            empty = docs.select(F.col(id_col).alias("id")).distinct()
            # a text without terms keeps a row of its own, so that its id is known
            postings = tfidf.packed_counts(docs, id_col, text_col).unionByName(
                _single(empty.select("id", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("tf"))))
        gone = minus = None
        if ids is not None and segments:
            gone = ids.select(F.col(ids.columns[0]).alias("id")).distinct().checkpoint()
            own = self._ids(segments, gone)
            if own is not None:
                own = own.checkpoint()
                minus, gone = own.where("term is not null"), own.select("id").distinct()
                n_docs -= gone.count()
        if postings is None and gone is None:
            return before
        segment = self._write(postings, n_new, gone, minus)
        return self._merged(self._commit(before, [*segments, segment], n_docs + n_new))

    def add(self, docs: DataFrame, id_col: str = "id", text_col: str = "text") -> dict:
        return self.replace(docs, id_col, text_col)

    def remove(self, ids: DataFrame) -> dict:
        return self.replace(None, ids=ids)

    def _merged(self, version: dict) -> dict:
        """Merges runs of ``FANOUT`` neighbours of one level, the newest first."""
        while True:
            segments = version["segments"]
            run = next((k for k in range(len(segments) - FANOUT, -1, -1)
                        if len({s["level"] for s in segments[k:k + FANOUT]}) == 1), None)
            if run is None:
                return version
            segment = self._joined(segments[run:run + FANOUT], oldest=run == 0)
            version = self._commit(version, [*segments[:run], segment, *segments[run + FANOUT:]], version["n_docs"])

    def _joined(self, run: list, oldest: bool) -> dict:
        name = uuid.uuid4().hex
        at = f"{self.path}/segments/{name}"
        rows, docs = self._rows(run), 0
        if rows is not None:
            rows.write.parquet(f"{at}/postings")
            docs = self.spark.read.parquet(f"{at}/postings").where("term is null").count()
        taken = [self._part(s, "gone") for s in run if s["gone"]]
        n_gone = 0
        if taken and not oldest:  # older segments outside the run may have these ids
            ids = taken[0]
            for t in taken[1:]:
                ids = ids.unionByName(t)
            ids.distinct().write.parquet(f"{at}/gone")
            n_gone = self.spark.read.parquet(f"{at}/gone").count()
        self._frequencies(run).where("df <> 0").write.parquet(f"{at}/df")
        return {"name": name, "docs": docs, "gone": n_gone, "level": run[0]["level"] + 1}

    def vacuum(self) -> int:
        """Removes the segments that the newest version does not name. To be
        run while nobody reads an older one."""
        named = {s["name"] for s in self.version()["segments"]}
        left = [n for n in self._names("segments") if n not in named]
        for n in left:
            self._fs.delete(self._at(f"segments/{n}"), True)
        return len(left)

    # -- readers ----------------------------------------------------------------

    def _frequencies(self, segments: list) -> DataFrame:
        out = None
        for s in segments:
            part = self._part(s, "df").select("term", "df")
            out = part if out is None else out.unionByName(part)
        return out.where("term is not null").groupBy("term").agg(F.sum("df").alias("df"))

    def model(self) -> tfidf.TfidfModel:
        """The vocabulary with the idf of all documents."""
        version = self.version()
        if not version["segments"]:
            return tfidf.TfidfModel(self.spark.createDataFrame([], "term string, df long, idf double"), 0, 0)
        vocab = tfidf.pruned(self._frequencies(version["segments"]).where("df > 0"), version["n_docs"], self.min_df, self.max_df).checkpoint()
        return tfidf.TfidfModel(vocab, version["n_docs"], vocab.count())

    def weights(self, model: tfidf.TfidfModel) -> DataFrame:
        """``(id, term, weight)`` unit rows of the documents of the index."""
        rows = self._live(self.version()["segments"])
        if rows is None:
            return self.spark.createDataFrame([], "id long, term string, weight double")
        return tfidf.weights(rows.where("term is not null"), model)
