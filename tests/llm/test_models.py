"""Language id, quality classifier and secret scan."""

import hashlib
import math
import random
import re
import string

import numpy as np
import pytest

from ticketlens.llm import language_id as L
from ticketlens.llm import quality_classifier as C
from ticketlens.llm import secret_scan as S
from tests.llm.conftest import crc, rows_of


@pytest.fixture(scope="module")
def languages(documents):
    return L.identify(documents).collect()


def test_language_accuracy_and_contract(corpus, languages):
    assert len(languages) == len(corpus)
    lang = {r[0]: r[2] for r in corpus}
    text = {r[0]: r[1] for r in corpus}
    for r in languages:
        assert r.held_out == (crc(r.doc_id, 3) == 1)
        if not re.search(r"[^\W\d_]", text[r.doc_id] or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("de", "en") and 0 <= r.score <= 1
    held = [r for r in languages if r.held_out and r.doc_id is not None and r.doc_id < 106]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_equal_texts_equal_predictions_and_no_leak(spark, documents, languages):
    got = {r.doc_id: (r.lang_pred, r.score) for r in languages}
    assert got[0] == got[207] == got[208]
    from pyspark.sql import functions as F
    swapped = documents.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, "zz").otherwise(F.col("lang")))
    assert rows_of(L.identify(swapped), "doc_id", "lang_pred", "score") == sorted(((r.doc_id, r.lang_pred, r.score) for r in languages), key=repr)


def test_folded_tables_equal_the_network(documents):
    net = L.train(L.sample(documents))
    windows = np.concatenate([L.windows_of(t.encode()) for t in ("the thing is", "über die Länder " * 40)])
    got = L.probabilities(windows, net, L.fold(net))
    for x, q in zip(windows, got):
        f = []
        for w, b in zip(L.WIDTHS, net["bias"]):
            act = [sum(net["taps"][w][j][x[t + j]] for j in range(w)) for t in range(L.WINDOW - w + 1)]
            f.append(np.maximum(np.max(act, axis=0) + b, 0))
        z = np.concatenate(f) @ net["o"] + net["ob"]
        assert q == pytest.approx(np.exp(z - z.max()) / np.exp(z - z.max()).sum(), abs=1e-5)


def test_language_odd_tables(empty, clashing, languages, spark):
    assert L.identify(empty).collect() == []
    assert rows_of(L.identify(clashing), "doc_id", "lang_pred") == sorted(((r.doc_id, r.lang_pred) for r in languages), key=repr)
    unlabelled = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert L.identify(unlabelled).collect()[0].lang_pred == "und"


@pytest.fixture(scope="module")
def scored(documents, labels):
    return C.score_quality(documents, labels).collect()


def test_quality_scores(corpus, scored):
    assert len(scored) == len(corpus)
    for r in scored:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (crc(r.doc_id, 4) == 2)
        if r.doc_id is not None and r.doc_id < 126:
            assert r.predicted == (0 if r.doc_id >= 106 else 1)
        if r.doc_id in (200, 201, 202):
            assert r.score == 0.0


def test_quality_density_matches_brute_force(spark, documents, labels):
    stats = C.statistics(documents)
    model = C.fit(stats, labels)
    rows = {r.doc_id: r for r in stats.collect()}
    train = [(r.quality, rows[r.doc_id].x) for r in labels.collect() if r.doc_id in rows and r.quality is not None and r.doc_id is not None and crc(r.doc_id, 4) != 2]
    extra = [(r.quality, rows[r.doc_id].x) for r in labels.collect() if r.doc_id == 5 and crc(5, 4) != 2]
    train += extra  # row 5 is repeated
    x, y = np.array([a for _, a in train]), np.array([q for q, _ in train])
    z = (x - x.mean(0)) / np.sqrt(np.maximum(x.var(0), 1e-12))
    d, pooled = x.shape[1], sum(np.cov(z[y == k].T, bias=True) * (y == k).sum() for k in (0, 1)) / len(y)
    logs = []
    probe = np.array(rows[7].x)
    zp = (probe - x.mean(0)) / np.sqrt(np.maximum(x.var(0), 1e-12))
    for k in (0, 1):
        c = np.cov(z[y == k].T, bias=True)
        c = (1 - C.SHRINKAGE) * c + C.SHRINKAGE * (0.5 * pooled + 0.5 * (np.trace(c) / d + 1e-3) * np.eye(d))
        e = zp - z[y == k].mean(0)
        logs.append(math.log((y == k).mean()) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * e @ np.linalg.solve(c, e))
    got = model.margin(probe[None], np.array([rows[7].n_words]))[0]
    assert got == pytest.approx(logs[1] - logs[0], rel=1e-6)


def test_quality_odd_tables(empty, documents, clashing, labels, scored, spark):
    assert C.score_quality(empty, labels).collect() == []
    assert rows_of(C.score_quality(clashing, labels), "doc_id", "score") == sorted(((r.doc_id, r.score) for r in scored), key=repr)
    none = C.score_quality(documents, labels.where("false")).collect()
    assert {r.score for r in none} == {0.0, 0.5}
    one = C.score_quality(documents, labels.where("quality = 1")).collect()
    assert {r.score for r in one} == {0.0, 1.0}
    kept = C.accepted(clashing, labels)
    assert kept.columns == clashing.columns and kept.count() == sum(r.predicted for r in scored)


HEX, B64 = "0123456789abcdef", string.ascii_letters + string.digits


def secrets_table(spark):
    rng = random.Random(1)
    pick = lambda a, n: "".join(rng.choices(a, k=n))
    ordinary = " ".join("getUserAccountBalance some_long_identifier_name internationalization 4929348385146306 the value of it".split() * 3)
    texts = [f'x token = "{pick(HEX, 40)}" y', f"AKIA{pick(string.ascii_uppercase + string.digits, 16)} AKIA12", f"Password: abc, PASSWD='{pick(B64, 9)}'",
             "api_key:abcdef apikey=abcde ſecret=longenough", f"é😀 {pick(HEX, 24)} {pick(HEX, 23)}", f"key {pick(B64, 40)} end", f"{pick(B64 + '+/', 44)}==",
             ordinary, None, "", "secret" * 3000 + f"={pick(HEX, 30)}", f"token={pick(HEX, 32)}token={pick(HEX, 32)}"]
    return spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, spans string"), texts


def brute_base(text):
    spans = []
    for m in re.finditer(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 6:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def test_secret_base_spans_match_brute_force(spark, documents):
    """The models are of the corpus: a dozen lines of secrets are no sample
    of ordinary text."""
    df, texts = secrets_table(spark)
    got = {r.doc_id: r for r in S.scan_secrets(df, S.train(documents)).collect()}
    for k, t in enumerate(texts):
        want = brute_base(t or "")
        assert [got[k].n_assign, got[k].n_access, got[k].n_hex] == [sum(s[1] == i for s in want) for i in range(3)], t
        joined = S.joined(want)
        assert got[k].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(got[k].spans.split(","))
    assert "markov" in got[5].spans and "markov" in got[6].spans and got[7].spans == ""


def test_markov_on_held_out_strings(documents):
    table = S.train(documents)
    rng = random.Random(99)
    flagged = lambda t: any(k == 3 for _, k, _ in S.all_spans(t, table)[1])
    keys = ["".join(rng.choices(B64, k=32)) for _ in range(200)]
    names = ["".join(rng.choices(["the", "onward", "inner", "lately", "stern", "from"], k=6)) for _ in range(200)]
    assert sum(map(flagged, keys)) >= 195 and sum(map(flagged, names)) <= 2


def test_markov_finds_keys_behind_ordinary_characters(documents):
    table = S.train(documents)
    rng = random.Random(98)
    for before in ("aws_secret_access_key=", "/from/onward/the/inner/lately/", "onward-inner-from-", "from_lately_onward_inner_stern_from="):
        hits = 0
        for _ in range(50):
            key = "".join(rng.choices(B64, k=24))
            spans = S.all_spans(f"x {before}{key} y", table)[1]
            hits += any(a <= 2 + len(before) and 26 + len(before) <= b for a, _, b in spans)
        assert hits >= 48, before
    for _ in range(200):
        words = rng.choices(["the", "onward", "inner", "lately", "stern", "from"], k=9)
        assert S.all_spans(rng.choice("/_-=").join(words), table)[1] == []


def test_markov_judges_what_base_spans_leave_of_a_run(documents):
    table = S.train(documents)
    rng = random.Random(97)
    key = "".join(rng.choices(B64, k=40))
    access = "AKIA" + "".join(rng.choices(string.ascii_uppercase + string.digits, k=16))
    for text in (f"x {access}/{key} y", f"x {key}_token=abcdef y"):
        at = text.index(key)
        assert any(k == 3 and a <= at and at + 40 <= b for a, k, b in S.all_spans(text, table)[1]), text


def test_redaction_and_odd_tables(spark, documents, clashing, empty):
    df, texts = secrets_table(spark)
    got = {r.doc_id: r.text for r in S.redact_secrets(df, S.train(documents)).collect()}
    assert got[0] == 'x [SECRET]" y' and got[8] is None and got[9] == "" and got[7] == texts[7]
    assert S.scan_secrets(empty).collect() == [] and S.redact_secrets(empty).collect() == []
    assert rows_of(S.scan_secrets(clashing), "doc_id", "spans") == rows_of(S.scan_secrets(documents), "doc_id", "spans")
    assert S.redact_secrets(clashing).columns == clashing.columns


def test_segments_take_linear_time():
    """The same segments as by brute force, and a long run in time."""
    import time
    rng = random.Random(12)
    for _ in range(300):
        scores = [rng.choice([-2, -1, 1, 2, 3]) for _ in range(rng.randrange(1, 14))]

        def best(a, b):  # the maximal segments are the best one and those of what is left of it and right of it
            if a >= b:
                return []
            top = max(((sum(scores[i:j]), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
            if top[0] <= 0:
                return []
            i, j = -top[2], -top[2] - top[1]
            return best(a, i) + [(i, j)] + best(j, b)

        got = S.segments(scores)
        assert sum(sum(scores[a:b]) for a, b in got) == sum(sum(scores[a:b]) for a, b in best(0, len(scores)))
        assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))
    took = []
    for n in (100_000, 800_000):
        scores = [rng.choice([-1.0, -0.8, 0.9, 0.7]) - 0.2 for _ in range(n)]
        start = time.process_time()
        S.segments(scores)
        took.append(time.process_time() - start)
    assert took[1] < 30 * took[0] + 1


def test_a_very_long_run(spark):
    """A run of 3 MB of ordinary characters with one secret in it."""
    import time
    rng = random.Random(13)
    words = "account/user_name/list-index/session/value/".split("/")
    ordinary = "/".join(rng.choices(words, k=400_000))
    secret = "".join(rng.choices(string.ascii_letters + string.digits, k=40))
    df = spark.createDataFrame([(1, ordinary + "/" + secret + "/" + ordinary[:1000]), (2, "x1" * 500_000)], "doc_id long, text string")
    start = time.time()
    rows = {r.doc_id: r for r in S.scan_secrets(df).collect()}
    at = len(ordinary) + 1
    assert f"markov:{at}:{at + 40}" in rows[1].spans and time.time() - start < 120
