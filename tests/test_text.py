import re

from pyspark.sql import functions as F

from ticketlens.functions.text import ngrams, serving_text, strip_ws, tokens, training_text  # noqa: F401

NBSP = " "


def _py_training(s, d):
    return re.sub(r"\s+", " ", f"{s or ''} {d or ''}".lower()).strip()


def test_training_text_collapses_unicode_whitespace(spark):
    rows = [(1, "Login\tFailed", f"line one\n\nline{NBSP}two  "), (2, None, "  Only Desc "),
            (3, "Subj", None), (4, " Em space ", "x y")]
    df = spark.createDataFrame(rows, "id long, s string, d string")
    got = {r.id: r.t for r in df.select("id", training_text("s", "d").alias("t")).collect()}
    for i, s, d in rows:
        assert got[i] == _py_training(s, d)


def test_serving_text_keeps_inner_whitespace(spark):
    rows = [(1, " A", f"B\t\tC{NBSP}"), (2, "x", "y"), (3, " ", "z")]
    df = spark.createDataFrame(rows, "id long, s string, d string")
    got = {r.id: r.t for r in df.select("id", serving_text("s", "d").alias("t")).collect()}
    for i, s, d in rows:
        assert got[i] == f"{s} {d}".lower().strip()


def test_strip_matches_python(spark):
    vals = [f"{NBSP} hi there 　", "\u0085x ", "", "   "]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(strip_ws("v")).collect()]
    assert got == [v.strip() for v in vals]


def test_tokens_and_ngrams(spark):
    df = spark.createDataFrame([("I a Foo_bar ÉTÉ 42 x9",), ("single",), ("",)], "t string")
    out = df.select(tokens("t").alias("tok")).select("tok", ngrams(F.col("tok")).alias("ng")).collect()
    py = re.compile(r"(?u)\b\w\w+\b")
    assert out[0].tok == py.findall("i a foo_bar été 42 x9")
    assert out[0].ng == out[0].tok + ["foo_bar été", "été 42", "42 x9"]
    assert out[1].ng == ["single"]       # one token: unigram only
    assert out[2].ng == []


def test_clean_reply_and_prompt(spark):
    from ticketlens.functions.prompts import clean_reply, user_prompt
    df = spark.createDataFrame([("  Hi there.\n", "Billing", "High", "Negative", "S", "D")],
                               "r string, c string, p string, s string, sub string, d string")
    r = df.select(clean_reply("r").alias("r"), user_prompt("c", "p", "s", "sub", "d").alias("u")).first()
    assert r.r == "Hi there."
    assert r.u.startswith("Ticket Category : Billing\nPriority        : High\n")
    assert r.u.endswith("\n\nWrite a suggested reply for the support agent to send to this customer.")


def test_encoder_hook(spark):
    from ticketlens.functions.encoder import encoder_column

    def load():
        return lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts]

    df = spark.createDataFrame([("a b c",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(encoder_column(F.col("t"), load, batch_size=2)).collect()]
    assert got == [[5.0, 2.0], [0.0, 0.0], [0.0, 0.0]]


def test_term_frequencies_match_counter(spark):
    import random
    from collections import Counter

    from ticketlens.functions.text import term_frequencies
    rng = random.Random(3)
    rows = [(k, [rng.choice("abcdé") * rng.randrange(1, 3) for _ in range(n)]) for k, n in enumerate((0, 1, 2, 50, 400))]
    df = spark.createDataFrame(rows, "id long, t array<string>")
    for r in df.select("id", term_frequencies("t").alias("f")).collect():
        assert {e.term: e.tf for e in r.f} == dict(Counter(rows[r.id][1])) and len(r.f) == len(set(rows[r.id][1]))
