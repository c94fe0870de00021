"""Centroid clustering and hard negatives, against brute force."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from ticketlens.llm import centroid_clustering as C
from ticketlens.llm import hard_negatives as H

VECTORS = "vec_id long, embedding array<float>, label int"


def vector(rng, centre=None, spread=1.0, n=64):
    return [(centre[k] if centre else 0.0) + rng.gauss(0, 0.125 * spread) for k in range(n)]


def floats(x):
    import numpy as np
    return None if x is None else [None if e is None else float(np.float32(e)) for e in x]


@pytest.fixture(scope="module")
def data():
    rng = random.Random(3)
    centres = [vector(rng) for _ in range(4)]
    rows = [[k, vector(rng, centres[k % 4], 0.4), k % 3] for k in range(300)]
    hot = vector(rng)
    rows += [[1000 + k, list(hot), k % 3] for k in range(150)]  # a third of all rows share a vector
    rows += [[2000, None, 1], [2100, [], 1], [2200, [0.5] * 63, 1], [2300, [0.5] * 65, 1], [2400, [None] + [0.1] * 63, 1],
             [2500, [float("nan")] + [0.1] * 63, 0], [2600, [float("inf")] * 64, 0], [2700, vector(rng), None], [None, vector(rng), 1],
             [2800, [0.0] * 64, 2], [2900, [-3.0] * 64, 77], [3000, [1e30] + [0.0] * 63, 1]]
    rows += [list(rows[100]), list(rows[100]), list(rows[7])]  # repeated rows, an anchor too
    return [[i, floats(x), y] for i, x, y in rows]


@pytest.fixture(scope="module")
def vectors(spark, data):
    return spark.createDataFrame([tuple(r) for r in data], VECTORS).repartition(5).cache()


def ok(x):
    return x is not None and all(e is not None and math.isfinite(e) for e in x)


def scaled(x, scale, limit):
    return [math.floor(max(-limit, min(limit, e * scale))) for e in x]


def brute_clusters(data, k=8, rounds=10, seed=3):
    rows = [(i, scaled(x, 1024, C.LIMIT)) for i, x, _ in data if ok(x) and len(x) == 64]
    first = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    cent = [list(x) for _, x in first[:k]]

    def near(x):
        d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in cent]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        groups = {}
        for _, x in rows:
            groups.setdefault(near(x)[0], []).append(x)
        for c, xs in groups.items():
            cent[c] = [sum(col) // len(xs) for col in zip(*xs)]
    out = [(i, *near(x)) for i, x in rows]
    per = {}
    for _, c, d in out:
        per[c] = per.get(c, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cent]
    return sorted(((i, c, d, min(per[c], C.MOST), min(sum(per.values()), C.MOST), sha[c]) for i, c, d in out), key=repr)


def test_clusters_equal_brute_force(vectors, data):
    got = sorted((tuple(r) for r in C.cluster(vectors).collect()), key=repr)
    assert got == brute_clusters(data)


def test_clusters_of_few_rows_and_clashing_columns(spark, vectors, data):
    few = [r for r in data if r[0] in (4, 5, 1001, 1002)]
    df = spark.createDataFrame([tuple(r) for r in few], VECTORS)
    for c in ("x", "norm", "dots", "cluster", "number", "k", "s", "distance"):
        df = df.withColumn(c, F.lit("extra"))
    assert sorted((tuple(r) for r in C.cluster(df).collect()), key=repr) == brute_clusters(few)
    empty = C.cluster(vectors.limit(0))
    assert empty.collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_dot_products_stay_exact(spark, vectors):
    import numpy as np
    rows = C.kept(vectors)
    cent = C.starts(rows, 8, 3)
    change = np.zeros_like(cent)
    change[2, [0, 5]] = [7, -3]
    change[4] = -11
    state = C.advanced(C.first_state(rows, cent), change)
    for r in state.collect():
        assert r.dots == [int(sum(a * b for a, b in zip(r.x, c))) for c in (cent + change).tolist()]
        assert r.norm == sum(a * a for a in r.x)


def brute_negatives(data):
    rows = []
    for k, (i, x, y) in enumerate(data):
        if y is not None and ok(x):
            v = scaled(x, 256, H.LIMIT)
            rows.append((k, i, (y + 1) % 10 if i is not None and i % 7 == 0 else y, v + [0] * (65 - len(v))))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for k, i, y, x in rows:
        if i is None or i % 100:
            continue
        score = [(sum(a * b for a, b in zip(x, v)), j, z, m) for m, j, z, v in rows if m != k]
        for s, p, _, _ in sorted((r for r in score if r[2] == y), key=order)[:5]:
            fit = sorted((r for r in score if r[2] != y and 80 * s <= 100 * r[0] <= 100 * s), key=order)[:5]
            out += [(i, p, n + 1, r[1], s, r[0]) for n, r in enumerate(fit)]
    return sorted(out, key=repr)


def test_negatives_equal_brute_force(vectors, data):
    want = brute_negatives(data)
    got = H.mine(vectors)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert len(want) > 50 and sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_negatives_of_odd_tables(spark, vectors):
    assert H.mine(vectors.limit(0)).collect() == []
    assert H.mine(vectors.where("vec_id = 100").limit(1)).collect() == []  # no other row of its label
    assert H.mine(vectors.where("vec_id = 7")).collect() == []  # no anchor
    odd = vectors.select("*", *[F.lit("extra").alias(c) for c in ("uid", "x", "norm", "anchor", "windows", "block", "part", "score", "high")])
    assert H.mine(odd).count() == H.mine(vectors).count()


def test_pairs_of_the_index_are_complete():
    import numpy as np
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(0, 32, (400, 64)))
    x[:50] *= rng.random((50, 64)) < 0.2  # sparse rows are indexed in fewer dimensions
    q = np.floor(rng.normal(0, 32, (30, 64)))
    for share in (-0.2, 0.0, 0.2, 0.4, 0.9):
        floors = share * np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1)).mean()
        index = H.Index(x, floors.min(), np.sqrt((q * q).sum(axis=1)).max())
        a, r, s = index.pairs(q, floors)
        exact = q @ x.T
        assert set(zip(a, r)) == set(zip(*np.nonzero(exact >= floors[:, None]))) and (s == exact[a, r]).all()
    assert index.indexed.min() < 64
