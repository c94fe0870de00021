"""Operator 9: secret scan by patterns and two character Markov models.

The base patterns give spans of kinds assign, access and hex. The method
adds spans of kind markov: runs of ``MIN_RUN`` or more token characters
outside base spans (what these leave of a run is judged by itself), with ``MIN_DIFFERENT`` or more different
characters (rulers and fillers have few), whose log-likelihood ratio between
a model of random strings and a model of ordinary words is at least
``MIN_RATIO`` a character. Of a run that has less as a whole, the parts
between separators and the best segments are judged alike, so ordinary
characters beside a secret do not hide it.

Both models are first-order chains over letters, digits and ``+/_=-.``,
smoothed by ``BACK_OFF`` counts in the proportions of the single characters
(one added to each), so rare contexts fall back on those. The labelled samples: ordinary text is all
text of the corpus outside base spans and ``SYNTHETIC`` identifiers of
common words in the usual styles, random text is all base spans of the
corpus and ``SYNTHETIC`` strings over the usual alphabets, both from a
seeded generator. Each task counts its own pairs of characters and returns
one row per pair; the driver gets the summed table of fixed size.

Defined cases: a null text is an empty one: no spans, the hash of the
empty string, empty spans; repeated rows get a row each; an empty table
gives an empty result; other columns are ignored. Positions are code
points, ends are exclusive; a span is the whole match.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.llm.common import small_batches, text_or_empty

KINDS = ("assign", "access", "hex", "markov")
MIN_RUN = 20
MIN_RATIO = 2.0
MIN_DIFFERENT = 8
MIDDLE = 1.2  # a character, between ordinary and random text
SEPARATORS = "=/_-"
SEPARATOR = re.compile("[=/_-]")
BACK_OFF = 20.0
SEED, SYNTHETIC = 9, 4000
MASK = "[SECRET]"

SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
N = len(SYMBOLS) + 1  # the last stands for everything else, and so for a word's start
IDENTIFIER_WORDS = (
    "get set user account name value list count index time date file path size type node data item key map read write open close "
    "start stop first last next total number error message result order balance session request response server client handler "
    "config option default update create delete find search load save check test event state buffer queue table column row page link "
    "source target parent child group label title image color width height left right long short some is has with for from")
ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", SYMBOLS[:62], SYMBOLS[:62] + "+/", SYMBOLS[:62] + "-_", SYMBOLS[:26] + SYMBOLS[52:62], SYMBOLS[26:62])

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# A run of 24 or more is found whole: it begins where it can first begin and takes all it can.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
PART = re.compile(r"[^%s]{%d,}" % (SEPARATORS, MIN_RUN))
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)

CODE = np.full(256, N - 1, dtype=np.int64)
for _k, _c in enumerate(SYMBOLS):
    CODE[ord(_c)] = _k


def base_spans(text: str) -> tuple[list, list]:
    """(start, kind number, end) of the base spans in order, and the runs.
    Every access and hex span lies in a run, as its characters are run
    characters and it is at least as long."""
    spans, runs = [], [m.span() for m in RUN.finditer(text)]
    if "=" in text or ":" in text:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    for a, b in runs:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, a, b)]
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text, a, b)]
    return sorted(spans), runs


def pair_counts(strings) -> np.ndarray:
    """Counts of neighbouring characters; what leads out of a word is 0."""
    raw = np.frombuffer((" " + " ".join(strings)).encode("utf-8", "replace"), dtype=np.uint8)
    s = CODE[raw]
    n = np.bincount(s[:-1] * N + s[1:], minlength=N * N).reshape(N, N)
    n[:, N - 1] = 0
    return n


def synthetic(seed: int = SEED, count: int = SYNTHETIC) -> list[str]:
    """Random strings of the usual alphabets and lengths."""
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABETS[k % len(ALPHABETS)], k=rng.randrange(20, 65))) for k in range(count)]


def identifiers(seed: int = SEED, count: int = SYNTHETIC) -> list[str]:
    """Ordinary identifiers: words in the usual styles, some numbered."""
    rng, out = random.Random(seed), []
    for k in range(count):
        words = rng.choices(IDENTIFIER_WORDS.split(), k=rng.randrange(2, 6))
        out.append((words[0] + "".join(w.capitalize() for w in words[1:]), "_".join(words), "-".join(words),
                    "_".join(words).upper(), "/".join(words), "".join(w.capitalize() for w in words))[k % 6] + ("", "", "", str(rng.randrange(100)))[k % 4])
    return out


def ratio_table(random_n: np.ndarray, ordinary_n: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each pair of characters."""
    logs = []
    for n in (random_n, ordinary_n):
        n = n[:, :N - 1].astype(float)
        single = (n.sum(axis=0) + 1) / (n.sum() + N - 1)
        logs.append(np.log((n + BACK_OFF * single) / (n.sum(axis=1, keepdims=True) + BACK_OFF)))
    return logs[0] - logs[1]


def train(docs: DataFrame) -> np.ndarray:
    def count(batches):
        import pyarrow as pa
        total = np.zeros((2, N, N), dtype=np.int64)
        for batch in batches:
            secret, plain = [], []
            for text in batch.column(0).to_pylist():
                spans, _ = base_spans(text)
                at = 0
                for a, _, b in spans:
                    if b > at:
                        plain.append(text[at:max(a, at)])
                        secret.append(text[max(a, at):b])
                        at = b
                plain.append(text[at:])
            total[0] += pair_counts(secret)
            total[1] += pair_counts(plain)
        where = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(total.ravel()[where])], names=["pair", "n"])

    small_batches(docs.sparkSession)
    rows = docs.select(text_or_empty("text").alias("text")).mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(2 * N * N, dtype=np.int64)
    for r in rows:
        total[r.pair] = r.n
    total = total.reshape(2, N, N)
    return ratio_table(total[0] + pair_counts(synthetic()), total[1] + pair_counts(identifiers()))


def ratios(table: np.ndarray, run: str) -> np.ndarray:
    s = CODE[np.frombuffer((" " + run).encode("ascii"), dtype=np.uint8)]
    return table[s[:-1], s[1:]]


def random_like(table: np.ndarray, run: str) -> bool:
    return len(run) >= MIN_RUN and len(set(run)) >= MIN_DIFFERENT and ratios(table, run).mean() >= MIN_RATIO


def segments(scores: list) -> list[tuple[int, int]]:
    """All maximal-scoring segments (Ruzzo and Tompa): (start, end). Each
    candidate knows the last one before it with a lower sum before, so a
    search never looks at one twice."""
    out, total = [], 0.0  # (start, end, sum before, sum after, the candidate with a lower sum before)
    for k, x in enumerate(scores):
        before, total = total, total + x
        if x <= 0:
            continue
        start = k
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= before:
                j = out[j][4]
            if j < 0 or out[j][3] >= total:
                break
            start, before = out[j][0], out[j][2]
            del out[j:]
        out.append((start, k + 1, before, total, j))
    return [x[:2] for x in out]


def random_parts(table: np.ndarray, run: str) -> list[tuple[int, int]]:
    """(start, end) of the random stretches of a run: the whole run, or else
    its parts between separators and its maximal-scoring segments (of the
    ratio less ``MIDDLE`` a character), widened to the next separators."""
    if random_like(table, run):
        return [(0, len(run))]
    found = [m.span() for m in PART.finditer(run) if random_like(table, m[0])]
    score = ratios(table, run) - MIDDLE
    if score[score > 0].sum() >= MIN_RUN * (MIN_RATIO - MIDDLE):
        whole: dict = {}  # a part between separators may have many segments
        cuts = [-1, *(m.start() for m in SEPARATOR.finditer(run)), len(run)]
        for a, b in segments(score.tolist()):
            left, right = cuts[bisect_left(cuts, a) - 1] + 1, cuts[bisect_left(cuts, b)]
            if (left, right) not in whole:
                whole[left, right] = random_like(table, run[left:right])
            if whole[left, right] or random_like(table, run[a:b]):
                found.append((left, right))
    out = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def all_spans(text: str, table: np.ndarray) -> tuple[list, list]:
    """(base spans, base and markov spans), as (start, kind number, end)."""
    base, runs = base_spans(text)
    added = []
    for a, b in runs:
        for s, e in [(s, e) for s, _, e in base if s < b and a < e] + [(b, b)]:
            if s > a:
                added += [(a + p, 3, a + q) for p, q in random_parts(table, text[a:s])]
            a = max(a, e)
    return base, sorted(base + added)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCAN = T.StructType([
    T.StructField("n_assign", T.LongType()), T.StructField("n_access", T.LongType()), T.StructField("n_hex", T.LongType()),
    T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


def scan_secrets(docs: DataFrame, table: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    table = train(docs) if table is None else table

    @F.pandas_udf(SCAN)
    def scan(texts):
        import pandas as pd
        rows = []
        for text in texts:
            base, spans = all_spans(text, table)
            n = [0, 0, 0]
            for _, k, _ in base:
                n[k] += 1
            rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        return pd.DataFrame(rows, columns=SCAN.names)

    small_batches(docs.sparkSession)
    return docs.select("doc_id", scan(text_or_empty("text")).alias("found")).select("doc_id", "found.*")


def redact_secrets(docs: DataFrame, table: np.ndarray | None = None, mask: str = MASK) -> DataFrame:
    """The documents with each stretch of spans replaced by ``mask`` and
    ``n_chars`` (where there is such a column) counted anew; a null text
    stays null and all other columns stay."""
    table = train(docs) if table is None else table

    @F.pandas_udf("string")
    def redact(texts):
        import pandas as pd
        out = []
        for text in texts:
            if text is None:
                out.append(None)
                continue
            parts, at, end = [], 0, -1
            for a, _, b in all_spans(text, table)[1]:
                if a >= end:
                    parts += [text[at:a], mask]
                at = end = max(b, end)
            out.append("".join([*parts, text[at:]]))
        return pd.Series(out, dtype=object)

    small_batches(docs.sparkSession)
    out = docs.withColumn("text", redact(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
