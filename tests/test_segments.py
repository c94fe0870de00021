"""The segmented index gives the rows of an index that is built anew."""

import os
import random

import pytest
from pyspark.sql import functions as F

from ticketlens.operators import knn, tfidf
from ticketlens.operators.segments import Conflict, SegmentedIndex

WORDS = [f"word{k}" for k in range(60)]


def texts(seed, ids):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS, k=rng.randrange(0, 30)))) for i in ids]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string")


def same_as_rebuilt(spark, index, docs):
    model, fresh = index.model(), tfidf.fit(frame(spark, docs), "id", "text")
    assert model.n_docs == fresh.n_docs == len(docs)
    assert sorted(map(tuple, model.vocabulary.select("term", "df", "idf").collect())) == sorted(map(tuple, fresh.vocabulary.select("term", "df", "idf").collect()))
    got = {(r.id, r.term): r.weight for r in index.weights(model).collect()}
    want = {(r.id, r.term): r.weight for r in tfidf.transform(frame(spark, docs), "id", "text", fresh).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    return model


def test_adds_removes_and_merges_equal_a_rebuild(spark, tmp_path):
    index, docs = SegmentedIndex(spark, str(tmp_path / "index")), {}
    for step in range(6):  # segments of one level are merged on the way
        new = texts(step, range(100 * step, 100 * step + 40))
        docs.update(new)
        index.add(frame(spark, new))
    assert len(index.version()["segments"]) <= 4
    changed, gone = texts(99, [3, 105, 210]), [7, 8, 300]
    index.replace(frame(spark, changed), ids=frame(spark, [(i, "") for i in [3, 105, 210, *gone, 12345]]).select("id"))
    docs.update(changed)
    docs = {i: t for i, t in docs.items() if i not in gone}
    model = same_as_rebuilt(spark, index, list(docs.items()))
    index.remove(frame(spark, [(3, "")]).select("id"))
    docs.pop(3)
    for step in range(6, 12):
        new = texts(step, range(100 * step, 100 * step + 40))
        docs.update(new)
        index.add(frame(spark, new))
    model = same_as_rebuilt(spark, index, list(docs.items()))
    assert index.vacuum() > 0
    # queries see the same neighbours
    q = frame(spark, texts(1234, range(9000, 9008)))
    fresh = tfidf.fit(frame(spark, list(docs.items())), "id", "text")
    tops = []
    for m, w in ((model, index.weights(model)), (fresh, tfidf.transform(frame(spark, list(docs.items())), "id", "text", fresh))):
        top = knn.similar_topk(q.select("id"), tfidf.transform(q, "id", "text", m), frame(spark, list(docs.items())).select("id"), w, 3)
        tops.append(sorted((r.query_id, r["rank"], r.id) for r in top.collect()))
    assert tops[0] == tops[1]


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def test_a_small_change_writes_little(spark, tmp_path):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(5000)]
    docs = [(i, " ".join(rng.choices(words, k=80))) for i in range(2000)]
    path = str(tmp_path / "index")
    index = SegmentedIndex(spark, path)
    index.add(frame(spark, docs).coalesce(2))
    before = size(path)
    index.add(frame(spark, [(5000 + i, " ".join(rng.choices(words, k=80))) for i in range(20)]).coalesce(1))
    assert size(path) - before < 0.05 * before  # 1 % of the documents, and the overhead of small files


def test_empty_and_conflicting_writers(spark, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path / "index"))
    assert index.model().n_docs == 0 and index.weights(index.model()).collect() == []
    assert index.remove(frame(spark, [(1, "")]).select("id"))["number"] == 0
    index.add(frame(spark, [(1, "login error"), (2, ""), (3, "login reset")]))
    old = index.version()
    index.add(frame(spark, [(4, "login again")]))
    with pytest.raises(Conflict):
        index._commit(old, [], 0)
    assert index.version()["n_docs"] == 4
    same_as_rebuilt(spark, index, [(1, "login error"), (2, ""), (3, "login reset"), (4, "login again")])
    assert index.weights(index.model()).where(F.col("id") == 2).collect() == []


def test_few_removed_ids_shuffle_no_postings(spark, tmp_path):
    """the removed ids go to the postings, and a batch has one row for
    each of its terms."""
    index = SegmentedIndex(spark, str(tmp_path / "index"))
    docs = texts(3, range(200))
    index.add(frame(spark, docs).coalesce(1))
    stored = index._part(index.version()["segments"][0], "postings").where("term is not null")
    assert stored.count() == stored.select("term").distinct().count()
    plan = index._ids(index.version()["segments"], frame(spark, [(3, "")]).select("id").distinct().checkpoint())._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    index.replace(frame(spark, docs[:5]), ids=frame(spark, docs[:5]).select("id"))
    same_as_rebuilt(spark, index, docs)
