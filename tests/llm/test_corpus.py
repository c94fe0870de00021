"""Codec, substring dedup, near-duplicates, mixing, fingerprints, pipeline."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ticketlens.llm import fingerprint as P
from ticketlens.llm import mixing as M
from ticketlens.llm import near_dedup as N
from ticketlens.llm import sentencepiece_codec as S
from ticketlens.llm import substring_dedup as D
from tests.llm.conftest import rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=S.MODEL)


def encoded(texts):
    ids, sizes = S.encode_texts(texts, S.load(S.MODEL))
    cut = np.concatenate([[0], np.cumsum(sizes)])
    return [ids[a:b].tolist() for a, b in zip(cut, cut[1:])]


def test_encoder_equals_the_models_own(library, corpus):
    texts = [r[1] or "" for r in corpus] + ["  two  spaces \n\t", "日本 😀 \x00", "▁x▁▁y", "lo" * 400 + " the", "<s></s><0x41>", " " * 40]
    assert encoded(texts) == [list(x) for x in library.encode(texts)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("abcdethings .\né我\U0001f600▁"), max_size=400), min_size=1, max_size=5))
def test_encoder_on_random_texts(texts):
    import sentencepiece
    own = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    assert encoded(texts) == [list(x) for x in own.encode(texts)]


def test_encoder_on_unbroken_texts(library):
    rng = random.Random(8)
    letters = "".join(rng.choices(["the", "ing", "qu", "x", "er", "an", "Z", "é"], k=400_000))  # one unit, several stretches of the index
    no_spaces = "".join(rng.choices("的一是不了人我在有他这为之大来以个中上们", k=60_000))
    texts = [letters, no_spaces, "ab " * 3]
    assert len(letters) > 2 * S.CHUNK and encoded(texts) == [list(x) for x in library.encode(texts)]


def test_met_units_give_the_same_ids(library, corpus):
    texts = [r[1] or "" for r in corpus]
    met, pieces = S.Met(), S.load(S.MODEL)
    for part in (texts[:40], texts[20:90], texts):  # most units are met already
        ids, sizes = S.encode_texts(part, pieces, met)
        cut = np.concatenate([[0], np.cumsum(sizes)])
        assert [ids[a:b].tolist() for a, b in zip(cut, cut[1:])] == [list(x) for x in library.encode(part)]
    assert len(met.number) == len({u for t in texts if t for u in S.UNIT.findall(S.SPACE + t.replace(" ", S.SPACE))})


def test_codec_round_trip_and_odd_rows(documents, empty, corpus):
    rows = S.decode(S.encode(documents)).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        assert r.decoded == r.text and (r.ids is None) == (r.text is None)
    assert S.decode(S.encode(empty)).collect() == []
    pieces = S.load(S.MODEL)
    assert S.decode_ids(np.array([-5, 10 ** 6, 1]), np.array([3]), pieces) == [""]


def brute_repeats(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    n = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {i + j for i in range(len(w) - window + 1) if n[tuple(w[i:i + window])] > 1 for j in range(window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


REPEATS = ("doc_id", "n_words", "n_removed", "kept_sha256")


@pytest.fixture(scope="module")
def deduped(documents):
    return rows_of(D.remove_repeats(documents), *REPEATS)


def test_substring_dedup_matches_brute_force(corpus, deduped):
    want = brute_repeats([r[1] for r in corpus], D.WINDOW)
    assert deduped == sorted(((r[0], *w) for r, w in zip(corpus, want)), key=repr)


def test_substring_dedup_on_branching_texts(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(40)}" for _ in range(400)]
    texts = []
    for _ in range(40):
        a, b = sorted(rng.sample(range(400), 2))
        words = base[a:b] + ["end"] * rng.randrange(60)
        if words and rng.random() < 0.5:
            words[rng.randrange(len(words))] = f"new{rng.random()}"
        texts.append(" ".join(words))
    df = spark.createDataFrame([(None if k % 7 == 0 else k % 30, t) for k, t in enumerate(texts)], "doc_id long, text string")
    want = sorted(((None if k % 7 == 0 else k % 30, *w) for k, (t, w) in enumerate(zip(texts, brute_repeats(texts, 35)))), key=repr)
    assert rows_of(D.remove_repeats(df), *REPEATS) == want
    old, D.BROADCAST_ANCHORS = D.BROADCAST_ANCHORS, 0
    try:
        assert rows_of(D.remove_repeats(df), *REPEATS) == want
    finally:
        D.BROADCAST_ANCHORS = old


def test_substring_dedup_odd_tables(empty, clashing, deduped):
    assert D.remove_repeats(empty).collect() == []
    assert rows_of(D.remove_repeats(clashing), *REPEATS) == deduped


@pytest.fixture(scope="module")
def classed(documents):
    return N.classes(documents).collect()


def shingle_set(text):
    w = WORD.findall(text or "")
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_match_brute_force(corpus, classed):
    """Classes are the components of the links at weighted similarity 0.8,
    computed here over all pairs with the operator's weights."""
    sets = [shingle_set(r[1]) for r in corpus]
    found = sorted((r.doc_id, r.class_id) for r in classed if r.doc_id is not None)
    assert len(classed) == len(corpus)
    same = {}
    for a, b in found:
        same.setdefault(b, set()).add(a)
    groups = {frozenset(g) for g in same.values()}
    assert frozenset(range(96, 106)) in groups and frozenset({0, 207, 208}) in groups and frozenset({200, 201}) in groups
    for i, p in enumerate(sets):
        for j in range(i):
            if p and sets[j] and corpus[i][0] is not None and corpus[j][0] is not None:
                jac = len(p & sets[j]) / len(p | sets[j])
                together = any({corpus[i][0], corpus[j][0]} <= g for g in groups)
                if jac >= 0.85:
                    assert together
                if jac < 0.3:
                    assert not together
    for r in classed:
        if r.doc_id is not None and 90 <= r.doc_id < 96:
            assert r.class_id == r.doc_id  # a shared passage is not a copy


def test_weighted_jaccard_and_sampling_agree(corpus):
    """The share of equal samples estimates the weighted similarity."""
    rng = np.random.default_rng(2)
    factors = (1 + rng.random(2 * N.WIDTH)).astype(np.float32)
    base = rng.integers(0, 2 ** 63, 400).astype(np.uint64)
    errors = []
    for edits in (2, 8, 20, 60):
        other = base.copy()
        other[rng.choice(400, edits, replace=False)] = rng.integers(0, 2 ** 63, edits).astype(np.uint64)
        text, values, counts = N.shingles(np.concatenate([base, other]), np.array([400, 400]))
        weights = N.weigh(values, counts, factors)
        cut = np.searchsorted(text, [0, 1, 2])
        codes = N.sample_hashes(values, weights, cut)
        bags = [(values[a:b], weights[a:b]) for a, b in zip(cut, cut[1:])]
        exact = N.weighted_jaccard(*bags)
        a, b = (dict(zip(v.tolist(), w.tolist())) for v, w in bags)
        low, high = (sum(f(a.get(s, 0), b.get(s, 0)) for s in a.keys() | b.keys()) for f in (min, max))
        assert exact == pytest.approx(low / high, rel=1e-5)
        errors.append((codes[0] == codes[1]).mean() - exact)
    assert max(map(abs, errors)) < 0.2 and abs(np.mean(errors)) < 0.1


def test_components_of_chains(spark):
    links = [(bytes([a]), bytes([a + 1])) for a in range(0, 40)] + [(b"\x64", b"\x66"), (b"\x65", b"\x66")]
    got = dict(rows_of(N.components(spark.createDataFrame(links, "x binary, y binary")), "node", "label"))
    assert {bytes(v) for k, v in got.items() if bytes(k) <= b"\x28"} == {b"\x00"} and {bytes(v) for k, v in got.items() if bytes(k) >= b"\x64"} == {b"\x64"}


def test_near_duplicates_odd_tables(empty, clashing, classed, corpus):
    assert N.classes(empty).collect() == [] and N.one_of_each(empty).collect() == []
    assert rows_of(N.classes(clashing), "doc_id", "class_id") == sorted(((r.doc_id, r.class_id) for r in classed), key=repr)
    kept = N.one_of_each(clashing)
    assert kept.columns == clashing.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len({(r.class_md) for r in classed}) and sum(i in range(96, 106) for i in ids) == 1 and 207 not in ids and 5 in ids


def test_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"v{rng.randrange(10 ** 6)}" for _ in range(300)]
    rows = [(0, " ".join(base))]
    for k in range(1, 300):
        words = list(base)
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(300)] = f"n{rng.random()}"
        rows.append((k, " ".join(words)))
    got = N.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0}


def test_large_group_at_the_limit_matches_brute_force(spark):
    """Hundreds of independently edited copies whose similarities scatter
    around the limit: the classes are the components of all links."""
    rng = random.Random(11)
    base = [f"v{rng.randrange(10 ** 6)}" for _ in range(400)]
    texts = []
    for k in range(300):
        words = list(base)
        for at in rng.sample(range(400), rng.randrange(4, 7)):
            words[at] = f"n{k}x{at}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    factors = N.frequencies(N.keyed(df))
    hashes = [r.w for r in df.select(N.word_hashes(F.col("text")).alias("w")).orderBy("doc_id").collect()]
    bags = []
    for h in hashes:
        _, values, counts = N.shingles(np.asarray(h, dtype=np.int64).view(np.uint64), np.array([len(h)]))
        bags.append((values, N.weigh(values, counts, factors)))
    near = np.array([[i != j and N.weighted_jaccard(bags[i], bags[j]) >= N.SIMILARITY for j in range(300)] for i in range(300)])
    assert 0 < near.sum() < 300 * 299
    label = list(range(300))
    while True:
        least = [min([label[i]] + [label[j] for j in np.flatnonzero(near[i])]) for i in range(300)]
        if least == label:
            break
        label = least
    assert len(set(label)) < 300
    assert {r.doc_id: r.class_id for r in N.classes(df).collect()} == dict(enumerate(label))


MIXED = ("doc_id", "size", "source_size", "target", "taken")


def brute_targets(rows):
    size = Counter()
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: M.WEIGHTS[k % 3] for k, s in enumerate(order)}
    total, full = 1.5 * sum(size.values()), set()
    while True:
        rest = total - sum(2 * size[s] for s in full)
        level = rest / sum(weight[s] for s in size if s not in full)
        more = {s for s in size if s not in full and weight[s] * level > 2 * size[s]}
        if not more:
            return size, {s: 2.0 * size[s] if s in full else weight[s] * level for s in size}
        full |= more


def test_mix_meets_targets(documents, corpus, clashing, empty):
    size, target = brute_targets(corpus)
    rows = M.mix(documents).collect()
    assert len(rows) == len(corpus)
    taken = Counter()
    for r in rows:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert r.size == 0 or r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    largest = Counter()
    for r in corpus:
        largest[r[3]] = max(largest[r[3]], len(WORD.findall(r[1] or "")))
    for s in size:
        assert abs(taken[s] - target[s]) <= largest[s]
    assert rows_of(M.mix(documents.repartition(7)), *MIXED) == sorted((tuple(r[n] for n in MIXED) for r in rows), key=repr)
    assert rows_of(M.mix(clashing), *MIXED) == sorted((tuple(r[n] for n in MIXED) for r in rows), key=repr)
    assert M.mix(empty).collect() == [] and M.mixed_documents(empty).collect() == []
    copies = M.mixed_documents(clashing)
    assert copies.columns == clashing.columns
    want = Counter()
    for r in rows:
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in copies.collect()) == Counter({k: v for k, v in want.items() if v})


def test_mix_over_several_levels(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET", 20)
    monkeypatch.setattr(M, "MERGE", 3)
    rng = random.Random(3)
    rows = [(k, "w " * rng.randrange(1, 60), "en", "hot" if k % 3 else f"s{k % 4}", 0) for k in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got, (size, target) = M.mix(df).collect(), brute_targets(rows)
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
    assert len(got) == 1500 and all(abs(taken[s] - target[s]) <= 60 for s in size)


def test_pivot_keeps_mass_and_expectation():
    rng = random.Random(1)
    sums = np.zeros(2)
    for _ in range(4000):
        x, y = M.pivot(30, 0.3, 50, 0.6, rng.random())
        assert 30 * x + 50 * y == pytest.approx(39) and (x in (0, 1) or y in (0, 1))
        sums += (x, y)
    assert sums / 4000 == pytest.approx([0.3, 0.6], abs=0.03)


def brute_subsequence(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@given(st.text("abcd", max_size=64), st.text("abcd", max_size=64))
def test_subsequence_in_bits(a, b):
    assert P.common_subsequence(a, b) == brute_subsequence(a, b)


def test_fingerprints_match_brute_force(corpus, documents, clashing, empty):
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    rows = sorted(((r[0], r[1] or "") for r in corpus), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for k, (doc_id, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        h = len(text) // 2
        changed = text[:len(text) - h] + following[:h]
        own, other, after = map(P.fingerprint, (text, changed, following))
        want.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, other, P.likeness(own, other), P.likeness(own, after)))
    got = rows_of(P.fingerprint_documents(documents), *names)
    assert got == sorted(want, key=repr)
    assert rows_of(P.fingerprint_documents(clashing), *names) == got
    assert P.fingerprint_documents(empty).collect() == []
    assert P.fingerprint_documents(documents.where("doc_id = 3")).head().near_next == 1.0


def test_rolling_hash_sees_seven_bytes_only():
    a, b = (np.frombuffer(x, dtype=np.uint8) for x in (b"first text, common end", b"other thing; common end"))
    assert P.rolling(a)[-4:].tolist() == P.rolling(b)[-4:].tolist()
    rng = random.Random(2)
    text = "".join(rng.choices("abcdefgh ", k=6000))
    assert P.likeness(P.fingerprint(text), P.fingerprint(text[:3000] + "edit" + text[3000:])) > 0.9
    assert P.likeness(P.fingerprint(text), P.fingerprint("".join(rng.choices("abcdefgh ", k=6000)))) == 0.0


def test_pipeline_stages(spark, clashing, labels, monkeypatch, tmp_path):
    """Each stage acts on what its predecessor kept."""
    import corpus_pipeline as C
    monkeypatch.setattr(C, "table", lambda *a: labels)
    docs, columns, seen = clashing, clashing.columns, {}
    for name, stage in C.STAGES:
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        if name != C.STAGES[-1][0]:
            assert sorted(docs.columns) == sorted(columns)
    ids = {k: {r.doc_id for r in v} for k, v in seen.items()}
    assert not ids["quality"] & set(range(106, 126)) and set(range(106)) <= ids["quality"]
    assert len(ids["near_duplicates"] & set(range(96, 106))) == 1 and 207 not in ids["near_duplicates"]
    assert ids["secrets"] == ids["near_duplicates"] >= ids["mix"] == ids["encode"]
    assert len(seen["encode"]) == len(seen["mix"]) and max(Counter(r.doc_id for r in seen["mix"]).values()) <= 2


def test_similarities_by_pairs_and_by_matrix_agree():
    rng = np.random.default_rng(6)
    factors = (1 + rng.random(2 * N.WIDTH)).astype(np.float32)
    pool = rng.integers(0, 2 ** 32, 60)
    texts = [np.sort(rng.choice(pool, rng.integers(0, 90))).astype(np.uint32) for _ in range(30)] + [np.zeros(0, dtype=np.uint32)]
    bags = [t.tobytes() for t in texts]
    whole = N.all_similarities(bags, bags, factors)
    among = N.all_similarities(bags, bags, factors, True)
    off = ~np.eye(len(bags), dtype=bool)
    assert among[off] == pytest.approx(whole[off])
    for i, a in enumerate(texts):
        pairs = N.similarities([bags[i]] * len(bags), bags, factors)
        assert pairs == pytest.approx(whole[i])
        for j, b in enumerate(texts):
            (va, ca), (vb, cb) = (np.unique(t.astype(np.uint64) << np.uint64(32), return_counts=True) for t in (a, b))
            assert N.weighted_jaccard((va, N.weigh(va, ca, factors)), (vb, N.weigh(vb, cb, factors))) == pytest.approx(whole[i, j], rel=1e-5)


def scattered(n, seed, edits=(4, 7), words=400):
    """Copies with edits of their own: similarities scatter around 0.8."""
    rng = random.Random(seed)
    base = [f"v{rng.randrange(10 ** 6)}" for _ in range(words)]
    out = []
    for k in range(n):
        text = list(base)
        for at in rng.sample(range(words), rng.randrange(*edits)):
            text[at] = f"n{k}x{at}"
        out.append(" ".join(text))
    return out


def test_more_texts_than_columns(spark, monkeypatch):
    """Where a band has more texts outside its largest class than columns,
    rounds find nearly all links, and the exact way all."""
    texts = scattered(90, 13)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {r.doc_id: r.class_id for r in N.classes(df).collect()}
    monkeypatch.setattr(N, "COLUMNS", 12)
    monkeypatch.setattr(N, "SLICE_TEXTS", 30)
    exact = {r.doc_id: r.class_id for r in N.classes(df, exact=True).collect()}
    assert exact == whole and 1 < len(set(whole.values())) < 90
    rounds = {r.doc_id: r.class_id for r in N.classes(df).collect()}
    assert sum(rounds[k] == whole[k] for k in whole) >= 0.9 * len(whole)


def test_all_texts_of_a_band_have_their_turn_as_columns(spark, monkeypatch):
    """Few columns give the classes of a comparison of all with all."""
    df = spark.createDataFrame(list(enumerate(scattered(90, 13))), "doc_id long, text string")
    exact = {r.doc_id: r.class_id for r in N.classes(df, exact=True).collect()}
    taken, own = [], N.compared
    monkeypatch.setattr(N, "COLUMNS", 3)
    monkeypatch.setattr(N, "SLICE_TEXTS", 8)
    monkeypatch.setattr(N, "compared", lambda *a: taken.append(a[7] if len(a) > 7 else 0) or own(*a))
    assert {r.doc_id: r.class_id for r in N.classes(df).collect()} == exact
    assert max(taken) > 0  # the parts after the first


def test_pairs_grow_with_a_group_not_with_its_square(spark):
    """Copies below the limit stay apart, and their candidates are linear."""
    made = []
    for n in (100, 400):
        df = spark.createDataFrame(list(enumerate(scattered(n, 17, (9, 10)))), "doc_id long, text string")
        factors = spark.sparkContext.broadcast(N.frequencies(N.keyed(df)))
        signed = N.signatures(df, factors)
        found = N.members(signed.select("md", "bands", "marks", "size"))
        made.append(N.candidates(found).count())
        if n == 100:
            assert len({r.class_id for r in N.classes(df).collect()}) > 50
    assert made[1] < 8 * made[0] + 400


def test_pipeline_on_an_empty_table(spark, empty, tmp_path):
    import corpus_pipeline
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path))
    assert rows.collect() == [] and "n_tokens" in rows.columns


def test_substring_dedup_of_null_ids_and_equal_rows(spark):
    """Texts of null ids are told apart, and equal rows share one list of
    coordinates."""
    rng = random.Random(21)
    passage = [f"p{k}" for k in range(50)]
    rows = []
    for k in range(200):
        words = [f"w{rng.randrange(10 ** 6)}" for _ in range(60)]
        rows.append((None if k % 2 else 7, " ".join(words[:30] + (passage if k % 3 == 0 else []) + words[30:])))
    rows += [(None, " ".join(f"e{k}" for k in range(90)))] * 400 + [(5, " ".join(f"e{k}" for k in range(90)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_repeats([t for _, t in rows], D.WINDOW)
    assert rows_of(D.remove_repeats(df), *REPEATS) == sorted(((i, *w) for (i, _), w in zip(rows, want)), key=repr)
    spans = D.repeated(df)
    assert spans.where("doc_id is null").dropDuplicates(["digest", "at", "n"]).groupBy("digest").count().agg(F.max("count")).first()[0] < 60


def test_many_texts_are_looked_up_by_a_bitmap(spark, monkeypatch):
    """Bags of more texts than a broadcast join takes: the driver gets a bitmap
    of fixed size, and no text is shuffled; classes stay the same."""
    rng = np.random.default_rng(3)
    base = [" ".join(f"w{i}" for i in rng.integers(0, 5000, 60)) for _ in range(200)]
    rows = [(i, f"{t} end{i}") for i, t in enumerate(base * 2)]
    df = spark.createDataFrame([*rows, (1000, ""), (1001, None)], "doc_id long, text string")
    before = sorted((r.doc_id, r.class_id, r.n_links) for r in N.classes(df).collect())
    assert sum(links > 0 for _, _, links in before) == 400
    monkeypatch.setattr(N, "BROADCAST_TEXTS", 10)
    monkeypatch.setattr(N, "BITMAP_BITS", 12)
    wanted = N.keyed(df.where("doc_id < 300")).select("md")
    bits = np.unpackbits(N.bitmap(wanted), bitorder="little")
    assert len(bits) == 1 << 12 and 300 < bits.sum() <= 600
    joins, make = [], type(df).join
    monkeypatch.setattr(type(df), "join", lambda self, *a, **b: joins.append(a) or make(self, *a, **b))
    bags = {bytes(r.md) for r in N.bags_of(df, wanted).collect()}
    assert not joins and bags >= {bytes(r.md) for r in wanted.collect()}
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in N.classes(df).collect()) == before
