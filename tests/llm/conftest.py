import random
import zlib

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the of and to in is that it for was on with as be by this are from thereby onward inner lately ringing stern".split()
DE = "der die und das von zu mit sich des auf für ist nicht dem ein eine auch schön über größer leiten werden".split()


def prose(rng, n, words=EN):
    out = []
    for k in range(n):
        w = rng.choice(words) if rng.random() < 0.5 else "".join(rng.choices(words, k=2))
        out.append(w.capitalize() if k % 12 == 0 else w + "." if k % 12 == 11 else w)
    return " ".join(out)


@pytest.fixture(scope="session")
def corpus():
    """Rows of documents: prose, copies, near copies, junk and odd rows."""
    rng = random.Random(4)
    rows = []
    for k in range(90):
        de = k % 3 == 0
        rows.append([k, prose(rng, rng.randrange(60, 160), DE if de else EN), "de" if de else "en", f"s{k % 5}", 0])
    shared = prose(rng, 60)
    for k in range(90, 96):
        rows.append([k, prose(rng, 30) + " " + shared + " " + prose(rng, 30), "en", "s1", 0])
    original = prose(rng, 150).split(" ")
    for k in range(96, 106):
        words = list(original)
        words[10 + 13 * (k - 96)] = f"edit{k}"
        rows.append([k, " ".join(words), "en", "s2", 0])
    for k in range(106, 126):
        rows.append([k, " | ".join(rng.choices(["xq", "zzv", "###", "%%"], k=90)), "en", "s3", 0])
    rows += [
        [200, None, "en", "s1", None], [201, "", "de", "s1", 0], [202, " \t\n ", None, None, 3], [None, "null id " + prose(rng, 70), "en", None, 1],
        [203, "word", "en", "s0", 4], [204, "same " * 400, "en", "s4", 1], [205, "x" * 5000, None, "s4", 1],
        [206, prose(rng, 30000), "en", "s0", 1], [207, rows[0][1], "de", "s0", 1], [208, rows[0][1], "de", None, 1],
        [209, "1234 5678 !!! ,,,", None, "s0", 1],
    ]
    rows.append(list(rows[5]))  # a repeated row
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    return spark.createDataFrame([tuple(r) for r in corpus], DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(documents):
    """The documents with extra columns named like the operators' own."""
    from pyspark.sql import functions as F
    names = ("host path rule size target taken bucket x w words key score predicted held_out md band spans hist range tail digest at n "
             "ids row label kept lang_pred letters n_words h k cuts").split()
    return documents.select("*", *[F.lit(f"extra {n}").alias(n) for n in names])


@pytest.fixture(scope="session")
def labels(spark, corpus):
    rows = [(r[0], 0 if 106 <= r[0] < 126 else 1, 0) for r in corpus if r[0] is not None and r[0] < 200]
    return spark.createDataFrame(rows + [(None, 1, 0), (3, None, 0), (99999, 1, 0)], "doc_id long, quality int, toxic int")


def crc(doc_id, n):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
