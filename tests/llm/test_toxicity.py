"""Toxicity: the chain against brute force, held-out accuracy, spans."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlens.llm import toxicity as X
from tests.llm.conftest import DE, EN, crc, prose, rows_of

WORDS = ["blarg", "snotface", "grubling", "foulmuck"]
STEM = "zorkel"


@pytest.fixture(scope="module")
def data():
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(700):
        toxic = int(k % 6 == 0)
        words = prose(rng, rng.randrange(20, 120), DE if k % 4 == 0 else EN).split(" ")
        for _ in range(rng.randrange(2, 6) * toxic):
            bad = STEM + rng.choice(["ung", "heit", "ando", "er"]) if k % 4 == 0 else rng.choice(WORDS)
            words.insert(rng.randrange(len(words)), rng.choice([bad, bad.upper(), f"“{bad}!”"]))
        rows.append((k, " ".join(words), "en", f"s{k % 3}", 0))
        labels.append((k, 1, toxic))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (1002, " \n\t", "en", "s", 0), (None, "no id and blarg, snotface here", "en", "s", 0),
             (1003, ("plain words " * 60000) + "blarg snotface-grubling", "en", "s", 0), (1004, "İ blarg İİ, BLARG x-foulmuck2", "en", "s", 0),
             (1005, "unblarged xsnotface ungrubling", "en", "s", 0), rows[6]]
    labels += [(None, 1, 1), (3, 1, None), (4, None, 7), (77777, 1, 1)]
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark, data):
    rows, labels = data
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).cache(),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache())


@pytest.fixture(scope="module")
def scored(tables):
    return X.score_toxicity(*tables).collect()


def test_contract_and_held_out_accuracy(data, scored):
    rows, labels = data
    truth = {i: t for i, _, t in labels if i is not None and i < 700 and t is not None}
    assert len(scored) == len(rows)
    for r in scored:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (crc(r.doc_id, 3) == 1)
    held = [r for r in scored if r.held_out and r.doc_id in truth]
    assert len(held) > 150 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)


def test_spans_are_the_toxic_words(data, scored):
    text = {i: t for i, t, *_ in data[0]}
    bad = 0
    for r in scored:
        if r.doc_id is not None and r.doc_id < 700 and r.doc_id % 6 == 0 and r.doc_id % 4:
            words = [w.strip("“!”.").lower() for w in text[r.doc_id].split(" ")]
            got = [text[r.doc_id][int(a):int(b)].lower() for a, b in (s.split(":") for s in r.spans.split(",") if s)]
            got = [w.strip("“!”.") for g in got for w in g.split()]
            bad += got != [w for w in words if w in WORDS]
    assert bad <= 2
    by_id = {r.doc_id: r for r in scored}
    n = len("plain words ") * 60000
    assert by_id[1003].spans == f"{n}:{n + 23}" and by_id[1003].predicted == 1
    assert by_id[1004].spans == "2:7,12:17,20:28" and by_id[None].predicted == 1
    assert by_id[1000].spans == by_id[1005].spans == "" and by_id[1000].score == by_id[1001].score == by_id[1002].score < 0.5


def brute(scores, pairs):
    total, toxic = 0.0, np.zeros(len(scores))
    for states in itertools.product((0, 1), repeat=len(scores)):
        w = sum(s * e for s, e in zip(states, scores)) + sum(pairs[a, b] for a, b in zip((0, *states), states))
        total += np.exp(w)
        toxic += np.exp(w) * np.array(states)
    return toxic / total


def test_chain_equals_brute_force():
    rng = np.random.default_rng(2)
    pairs = rng.normal(0, 1, (2, 2))
    scores = rng.normal(0, 1, (3, 9))
    mask = np.arange(9) < np.array([9, 4, 1])[:, None]
    got, both = X.forward_backward(scores, mask, pairs)
    for i, n in enumerate((9, 4, 1)):
        assert got[i, :n] == pytest.approx(brute(scores[i, :n], pairs)) and (got[i, n:] == 0).all()
    assert both[0].sum(axis=(1, 2)) == pytest.approx(np.ones(9))
    # stretches of ordinary tokens as powers of one matrix
    model = X.Field(["a", "b"], np.array([1.5, -0.7]), bias=-0.4, pairs=pairs)
    texts = [([(0, 0, 2, [0]), (0, 0, 0, [0, 1]), (0, 0, 4, [1])], 3), ([], 5), ([(0, 0, 0, [1])], 0), ([(0, 0, 5, [0]), (0, 0, 1, [0])], 2)]
    for (hits, after), p in zip(texts, X.marginals(model, texts)):
        tokens, at = [], []
        for _, _, gap, known in hits:
            tokens += [model.bias] * gap + [model.bias + model.weights[known].sum()]
            at.append(len(tokens) - 1)
        assert p == pytest.approx(brute(tokens + [model.bias] * after, pairs)[at] if hits else np.zeros(0))


def test_gradient_is_that_of_the_likelihood():
    # after the steps of training expected and labelled counts nearly agree
    sequences = [[([], 0), ([0], 1), ([0, 1], 1)], [([1], 0), ([], 0)], [([0], 1), ([], 0), ([1], 0)], [([0], 0)]] * 20
    model = X.train(sequences, ["a", "b"])
    for f in (0, 1):
        want = sum(t for s in sequences for k, t in s if f in k)
        got = 0.0
        for s in sequences:
            e = [model.bias + model.weights[k].sum() for k, _ in s]
            got += sum(p for p, (k, _) in zip(brute(e, model.pairs), s) if f in k)
        assert got == pytest.approx(want, rel=0.05)


def test_no_leak_and_clashing_columns(tables, scored):
    docs, labels = tables
    want = rows_of(X.score_toxicity(docs, labels), "doc_id", "score", "spans")
    assert want == sorted(((r.doc_id, r.score, r.spans) for r in scored), key=repr)  # reruns agree
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    odd = docs.select("*", *[F.lit(f"extra {c}").alias(c) for c in "toxic half md part score predicted held_out spans form key n gaps forms after quality".split()])
    assert rows_of(X.score_toxicity(odd.repartition(2), flipped), "doc_id", "score", "spans") == want


def test_odd_tables(spark, tables):
    docs, labels = tables
    few = docs.where("doc_id < 20 or doc_id is null")
    assert X.score_toxicity(docs.limit(0), labels).collect() == []
    assert {(r.score, r.predicted) for r in X.score_toxicity(few, labels.limit(0)).collect()} == {(0.5, 0)}
    assert {(r.score, r.predicted) for r in X.score_toxicity(few, labels.where("toxic = 1")).collect()} == {(1.0, 1)}
    assert {r.predicted for r in X.score_toxicity(few, labels.where("toxic = 0")).collect()} == {0}
