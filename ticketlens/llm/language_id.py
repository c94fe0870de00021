"""Operator 5: language identification by a byte convolutional network.

Texts are cut into windows of ``WINDOW`` bytes that cover them whole. A
window's bytes are embedded, filtered at widths 2, 3 and 4, rectified,
max-pooled and classified by a softmax layer; a text's probabilities are
the means over its windows, weighted by their bytes. The network is
trained in numpy with Adam on windows of a bounded sample: ``PER_LANG``
documents per language, the first by a hash of doc_id, three stretches of
each. In tasks an embedding and a filter fold into one table per tap, so a
filter is a sum of table rows, and windows are worked off in blocks of
fixed size.

Defined cases: a null text, or one without letters, is ``und`` with score
0, as is every text when there is nothing to learn from; rows with null
lang, null doc_id or null text are not learned from; a null doc_id is not
held out; equal texts get equal predictions; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.llm.common import crc_mod, small_batches, text_or_empty

FOLDS, HELD_OUT = 3, 1
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBEDDING = 8
PER_LANG = 400
EPOCHS = 12
BATCH = 64
RATE = 0.01
SEED = 5
BLOCK = 128  # windows worked on at once
GROUP = 1 << 18  # characters of texts that are cut into windows at once


def windows_of(data: bytes) -> np.ndarray:
    """Windows that cover the bytes, the last one filled with spaces."""
    n = -(-len(data) // WINDOW)
    return np.frombuffer(data.ljust(n * WINDOW), dtype=np.uint8).reshape(n, WINDOW)


def sample(docs: DataFrame, per_lang: int = PER_LANG) -> list:
    """(lang, stretch of text) of a bounded number of rows per language: the
    first by a hash, ranked in three rounds that each keep per_lang rows per
    language and task before their shuffle."""
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & F.coalesce(crc_mod("doc_id", FOLDS) != HELD_OUT, F.lit(False)))
    n = F.length("text")
    cuts = [F.substr("text", F.greatest(F.lit(1), (n * F.lit(s)).cast("int")), F.lit(WINDOW)) for s in (0.0, 0.35, 0.7)]
    rows = rows.select("lang", F.xxhash64("doc_id").alias("h"), "doc_id", F.array(*cuts).alias("cuts"))
    # first among few tasks, then among the winners: no task gathers what all others kept
    for salts in (1024, 32, 1):
        rows = rows.withColumn("salt", F.spark_partition_id() % salts)
        first = Window.partitionBy("lang", "salt").orderBy("h", "doc_id", "cuts")
        rows = rows.withColumn("k", F.row_number().over(first)).where(F.col("k") <= per_lang)
    return [(r.lang, c) for r in rows.select("lang", "k", "cuts").orderBy("lang", "k").collect() for c in r.cuts]


def train(examples: list, seed: int = SEED) -> dict | None:
    """The network's parameters, or None without examples."""
    langs = sorted({x for x, _ in examples})
    if not langs:
        return None
    x = np.stack([windows_of(t.encode("utf-8", "replace")[:WINDOW])[0] for _, t in examples if t])
    y = np.array([langs.index(k) for k, t in examples if t])
    rng = np.random.default_rng(seed)
    p = {"e": rng.normal(0, 0.3, (256, EMBEDDING)), "o": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))), "ob": np.zeros(len(langs))}
    for w in WIDTHS:
        p[f"w{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w * EMBEDDING, FILTERS))
        p[f"b{w}"] = np.zeros(FILTERS)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rows = order[at:at + BATCH]
            xb, yb = x[rows], y[rows]
            n = len(rows)
            emb = p["e"][xb]
            pooled, kept = [], []
            for w in WIDTHS:
                span = np.concatenate([emb[:, j:WINDOW - w + 1 + j] for j in range(w)], axis=2)
                act = span @ p[f"w{w}"] + p[f"b{w}"]
                best = act.argmax(axis=1)
                top = np.take_along_axis(act, best[:, None, :], axis=1)[:, 0]
                pooled.append(np.maximum(top, 0))
                kept.append((span, best, top > 0))
            f = np.concatenate(pooled, axis=1)
            logits = f @ p["o"] + p["ob"]
            q = np.exp(logits - logits.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            q[np.arange(n), yb] -= 1
            q /= n
            g = {"o": f.T @ q, "ob": q.sum(axis=0), "e": np.zeros_like(p["e"])}
            back = q @ p["o"].T
            for k, w in enumerate(WIDTHS):
                span, best, on = kept[k]
                d = back[:, k * FILTERS:(k + 1) * FILTERS] * on
                at_best = span[np.arange(n)[:, None], best]
                g[f"w{w}"] = np.einsum("nfd,nf->df", at_best, d)
                g[f"b{w}"] = d.sum(axis=0)
                into = np.einsum("nf,df->nfd", d, p[f"w{w}"]).reshape(n, FILTERS, w, EMBEDDING)
                for j in range(w):
                    np.add.at(g["e"], xb[np.arange(n)[:, None], best + j], into[:, :, j])
            step += 1
            for key in p:
                m[key] = 0.9 * m[key] + 0.1 * g[key]
                v[key] = 0.999 * v[key] + 0.001 * g[key] ** 2
                p[key] -= RATE * (m[key] / (1 - 0.9 ** step)) / (np.sqrt(v[key] / (1 - 0.999 ** step)) + 1e-8)
    taps = {w: [(p["e"] @ p[f"w{w}"][j * EMBEDDING:(j + 1) * EMBEDDING]).astype(np.float32) for j in range(w)] for w in WIDTHS}
    return {"langs": langs, "taps": taps, "bias": [p[f"b{w}"].astype(np.float32) for w in WIDTHS], "o": p["o"], "ob": p["ob"]}


def pair_table(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, None, :] + b[None, :, :]).reshape(65536, -1)


def fold(net: dict) -> dict:
    """Tables over two neighbouring bytes: widths 2, 3 and 4 take one row,
    a row and a single tap, and two rows."""
    t = net["taps"]
    return {"first": {w: pair_table(t[w][0], t[w][1]) for w in WIDTHS}, "third": t[3][2], "last": pair_table(t[4][2], t[4][3])}


def probabilities(windows: np.ndarray, net: dict, tables: dict) -> np.ndarray:
    out = np.empty((len(windows), len(net["langs"])))
    for at in range(0, len(windows), BLOCK):
        x = windows[at:at + BLOCK].astype(np.int32)
        two = x[:, :-1] * 256 + x[:, 1:]
        acts = [np.take(tables["first"][2], two, axis=0)]
        a = np.take(tables["first"][3], two[:, :-1], axis=0)
        a += np.take(tables["third"], x[:, 2:], axis=0)
        acts.append(a)
        a = np.take(tables["first"][4], two[:, :-2], axis=0)
        a += np.take(tables["last"], two[:, 2:], axis=0)
        acts.append(a)
        f = np.concatenate([np.maximum(a.max(axis=1) + b, 0) for a, b in zip(acts, net["bias"])], axis=1)
        logits = np.einsum("nf,fk->nk", f.astype(np.float64), net["o"]) + net["ob"]
        q = np.exp(logits - logits.max(axis=1, keepdims=True))
        out[at:at + BLOCK] = q / q.sum(axis=1, keepdims=True)
    return out


def identify(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    small_batches(docs.sparkSession)
    net = train(sample(docs, per_lang))
    text = text_or_empty("text")
    held_out = F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    if net is None:
        return docs.select("doc_id", held_out, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def predicted(texts, tables):
        """(language, score) of texts that have bytes."""
        data = [t.encode("utf-8", "replace") for t in texts]
        each = [windows_of(d) for d in data]
        q = probabilities(np.concatenate(each), net, tables)
        at = 0
        for d, w in zip(data, each):
            weight = np.full(len(w), float(WINDOW))
            weight[-1] = len(d) - WINDOW * (len(w) - 1)
            mean = weight @ q[at:at + len(w)] / weight.sum()
            at += len(w)
            k = int(mean.argmax())
            yield net["langs"][k], min(1.0, round(float(mean[k]), 6))

    def run(batches):
        import pyarrow as pa
        tables = fold(net)
        for batch in batches:
            found, group, size = [], [], 0
            for t in batch.column(3).to_pylist():
                if group and size + len(t) > GROUP:
                    found += predicted(group, tables)
                    group, size = [], 0
                group.append(t or " ")
                size += len(t)
            if group:
                found += predicted(group, tables)
            letters = batch.column(2).to_pylist()
            found = [f if ok else ("und", 0.0) for f, ok in zip(found, letters)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out, text.rlike(r"\p{L}").alias("letters"), text.alias("text")).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
