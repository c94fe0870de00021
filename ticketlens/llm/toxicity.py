"""Operator 13: toxicity by a linear-chain conditional random field.

Tokens are runs of letters. The labels at hand are of documents, so tokens
are labelled from them: a token of a toxic document is toxic if one of its
forms (the lower-case word, its first 4 to 7 letters) is found in toxic
documents far more often than in others: by ``MIN_LIFT`` times the share of
documents and by a likelihood ratio of at least ``MIN_RATIO``, in both halves
of the sample (a form that is frequent by chance fails in the other half, and
a form of a language or topic with more toxic documents lacks the lift). All other tokens are labelled ordinary.

The field has two states. A token's score for the toxic state is a bias
plus the weights of its known forms, and each pair of neighbours has a
weight; all are trained by gradients of the conditional likelihood
(forward-backward) on the labelled tokens. Scoring scans a whole text once
for the known forms. Tokens without any are alike, so a stretch of n of
them is one matrix to the power n, and the marginals are those of the
chain over all tokens. A document's score is a logistic function
of the log of its marginals' sum, fitted to the document labels; toxic
tokens (marginal ``TAG`` or more) that touch form the offending spans.

Only the learning uses a sample: about ``SAMPLE`` documents of each class,
by a hash of doc_id; rows of the sample that are equal count once. The
driver gets the known forms (``FORMS`` at the most, those of the highest
ratios) and the sample's hits, never texts. Scoring is one pass without a
shuffle; a task holds one batch of texts, in time linear in their length.

Defined cases: a null or empty text has no token and scores as a text
without hits; null doc_id: never held out, never learned from; null or
other labels than 0 and 1 are not learned from; a document with both
labels counts for both; without forms (no labels, one class, too few rows)
the score is the share of toxic documents, 0.5 without labels; equal texts
get equal scores; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import crc_mod, cut, small_batches, text_or_empty

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
SAMPLE = 3000
FORMS = 1024
MIN_RATIO = 10.8
MIN_LIFT = 8
PREFIXES = (4, 5, 6, 7)
LONGEST = 32  # letters of a form
TAG = 0.5
SMALL = 0.05  # added to a document's mass before the log
CHUNK, GAP = 16, 6  # hits of a training sequence, ordinary tokens kept between two
STEPS, RATE, RIDGE = 200, 0.1, 0.05
LETTERS = re.compile(r"[^\W\d_]+")


def lowered(text: str) -> str:
    """Lower case, of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def forms_of(token: str):
    """The forms of a lower-case token; prefixes end with a star."""
    if len(token) <= LONGEST:
        yield token
    for n in PREFIXES:
        if len(token) > n:
            yield token[:n] + "*"


def is_letter(c: str) -> bool:
    return c.isalnum() and not c.isdecimal()


def ordinary(text: str) -> int:
    """Number of tokens between two hits (or behind the last), by spaces:
    marks that cling to a hit are no tokens."""
    words = text.split()
    if not words:
        return 0
    clings = not text[0].isspace() and not LETTERS.search(words[0])
    clings += len(words) > 1 and not text[-1].isspace() and not LETTERS.search(words[-1])
    return len(words) - clings


class Finder:
    """Finds the tokens of a text that have known forms."""

    def __init__(self, forms: list[str]):
        import ahocorasick
        by_text: dict = {}
        for k, f in enumerate(forms):
            by_text.setdefault(f.rstrip("*"), []).append((k, not f.endswith("*")))
        self.automaton = ahocorasick.Automaton()
        for text, entries in by_text.items():
            self.automaton.add_word(text, (len(text), entries))
        if by_text:
            self.automaton.make_automaton()

    def hits(self, text: str):
        """([(start, end, tokens before, forms)], tokens after the last)."""
        low, found = lowered(text), {}
        if low and len(self.automaton):
            for last, (size, entries) in self.automaton.iter(low):
                start = last - size + 1
                if start and is_letter(low[start - 1]):
                    continue
                inside = last + 1 < len(low) and is_letter(low[last + 1])
                for k, whole in entries:
                    if whole != inside:  # a word ends here, a prefix goes on
                        found.setdefault(start, []).append(k)
        out, at = [], 0
        for start in sorted(found):
            end = LETTERS.match(low, start).end()
            out.append((start, end, ordinary(low[at:start]), found[start]))
            at = end
        return out, ordinary(low[at:])


@dataclass
class Field:
    """forms and their weights, the toxic state's bias, and the weights of
    neighbouring states (ordinary, toxic)."""
    forms: list
    weights: np.ndarray
    bias: float = -2.0
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    slope: tuple = (0.0, 1.0)

    def score_of(self, mass: np.ndarray) -> np.ndarray:
        z = self.slope[0] + self.slope[1] * np.log(mass + SMALL)
        return np.round(1 / (1 + np.exp(-np.clip(z, -40, 40))), 6)


def forward_backward(scores: np.ndarray, mask: np.ndarray, pairs: np.ndarray):
    """Marginals of the toxic state and of neighbouring states, token by
    token, of padded sequences; an ordinary token precedes each."""
    n, width = scores.shape
    step, e = np.exp(pairs), np.ones((n, width, 2))
    e[:, :, 1] = np.exp(np.clip(scores, -30, 30))
    alpha, beta = np.zeros((n, width + 1, 2)), np.ones((n, width + 1, 2))
    alpha[:, 0, 0] = 1
    for t in range(width):
        a = (alpha[:, t] @ step) * e[:, t]
        alpha[:, t + 1] = np.where(mask[:, t, None], a / a.sum(axis=1, keepdims=True), alpha[:, t])
    for t in range(width - 1, -1, -1):
        b = (beta[:, t + 1] * e[:, t]) @ step.T
        beta[:, t] = np.where(mask[:, t, None], b / b.sum(axis=1, keepdims=True), beta[:, t + 1])
    both = alpha[:, :-1, :, None] * step * (e * beta[:, 1:])[:, :, None, :]
    both = both / both.sum(axis=(2, 3), keepdims=True) * mask[:, :, None, None]
    return both[:, :, :, 1].sum(axis=2), both


def train(sequences: list, forms: list) -> Field:
    """The field of labelled sequences: lists of (forms, toxic) by token."""
    width = max(map(len, sequences))
    mask = np.zeros((len(sequences), width), dtype=bool)
    truth = np.zeros((len(sequences), width), dtype=np.int64)
    row, col, form = [], [], []
    for i, tokens in enumerate(sequences):
        mask[i, :len(tokens)] = True
        for t, (known, toxic) in enumerate(tokens):
            truth[i, t] = toxic
            row += [i] * len(known)
            col += [t] * len(known)
            form += known
    row, col, form = (np.array(v, dtype=np.int64) for v in (row, col, form))
    before = np.concatenate([np.zeros((len(truth), 1), dtype=np.int64), truth[:, :-1]], axis=1)
    wanted = np.zeros((2, 2))
    np.add.at(wanted, (before[mask], truth[mask]), 1)
    model = Field(forms, np.zeros(len(forms)))
    x = np.concatenate([model.weights, [model.bias], model.pairs.ravel()])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, STEPS + 1):
        weights, bias, pairs = x[:-5], x[-5], x[-4:].reshape(2, 2)
        scores = np.full(mask.shape, bias)
        np.add.at(scores, (row, col), weights[form])
        toxic, both = forward_backward(scores, mask, pairs)
        miss = (toxic - truth) * mask
        g = np.concatenate([np.bincount(form, weights=miss[row, col], minlength=len(forms)), [miss.sum()], (both.sum(axis=(0, 1)) - wanted).ravel()])
        g = g / len(sequences) + RIDGE / len(sequences) * x
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    model.weights, model.bias, model.pairs = x[:-5], float(x[-5]), x[-4:].reshape(2, 2)
    return model


def stretches(n: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Powers of the matrix of an ordinary token, up to a factor."""
    out = np.broadcast_to(np.eye(2), (len(n), 2, 2)).copy()
    n = n.copy()
    while n.any():
        odd = (n & 1).astype(bool)
        out[odd] = out[odd] @ step
        out[odd] /= out[odd].sum(axis=(1, 2), keepdims=True)
        step = step @ step
        step /= step.sum()
        n >>= 1
    return out


def marginals(model: Field, texts: list) -> list[np.ndarray]:
    """Marginals of the toxic state at the hits of each text, as ``hits``
    gives them. Texts take their k-th hit together."""
    step = np.exp(model.pairs)
    plain = step * np.array([1.0, np.exp(model.bias)])
    sizes = np.array([len(found) for found, _ in texts], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    flat = [h for found, _ in texts for h in found]
    e = np.ones((len(flat), 2))
    e[:, 1] = np.exp(np.clip([model.bias + model.weights[h[3]].sum() for h in flat], -30, 30))
    into = stretches(np.array([h[2] for h in flat], dtype=np.int64), plain) @ step * e[:, None, :]
    behind = stretches(np.array([after for _, after in texts], dtype=np.int64), plain).sum(axis=2)
    alpha, beta = np.zeros((len(flat), 2)), np.ones((len(flat), 2))
    order = np.argsort(-sizes, kind="stable")
    longest = int(sizes.max()) if len(sizes) else 0
    for k in range(longest):
        own = order[:np.searchsorted(-sizes[order], -k, side="left")]  # texts with more than k hits
        at = starts[own] + k
        a = into[at, 0] if not k else (alpha[at - 1, None, :] @ into[at])[:, 0]
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    for k in range(longest - 1, -1, -1):
        own = order[:np.searchsorted(-sizes[order], -k, side="left")]
        at, last = starts[own] + k, sizes[own] == k + 1
        b = np.empty((len(own), 2))
        b[last] = behind[own[last]]
        more = at[~last] + 1
        b[~last] = (into[more] @ beta[more, :, None])[:, :, 0]
        beta[at] = b / b.sum(axis=1, keepdims=True)
    both = alpha * beta
    p = both[:, 1] / both.sum(axis=1) if len(flat) else np.zeros(0)
    return [p[a:a + n] for a, n in zip(starts.tolist(), sizes.tolist())]


def labelled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict]:
    """(toxic, half, text) of the sample, and the class sizes that it stands
    for."""
    own = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(
        F.col("toxic").isin(0, 1) & F.coalesce(crc_mod("doc_id", FOLDS) != HELD_OUT, F.lit(False)))
    sizes = {r.toxic: r.n for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    part = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 30)) / float(1 << 30)
    rate = F.lit(0.0)
    for c, n in sizes.items():
        rate = F.when(F.col("toxic") == c, F.lit(min(1.0, SAMPLE / n))).otherwise(rate)
    few = own.where(part < rate).distinct()  # about SAMPLE rows of each class
    text = text_or_empty("text")
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(few), "doc_id")
    rows = cut(rows.groupBy("doc_id", "toxic", F.md5(F.col("text").cast("binary")).alias("md")).agg(F.first("text").alias("text")))
    counts = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    # many different texts of one doc_id are thinned as well
    thin = F.pmod(F.xxhash64("doc_id", "md"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.lit(1.0)
    for c, n in counts.items():
        rate = F.when(F.col("toxic") == c, F.lit(min(1.0, 2 * SAMPLE / n))).otherwise(rate)
    return rows.where(thin < rate).select("toxic", F.pmod(F.xxhash64("md", F.lit(5)), F.lit(2)).cast("int").alias("half"), "text"), sizes


def ratio(a, b, n_a, n_b) -> np.ndarray:
    """Likelihood ratio (G squared) of a form found in a of n_a toxic and b
    of n_b other documents; 0 where it is not commoner in toxic ones."""
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    share = (a + b) / (n_a + n_b)

    def part(x, n, p):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log(x / np.maximum(n * p, 1e-300)), 0.0) + np.where(n - x > 0, (n - x) * np.log((n - x) / np.maximum(n * (1 - p), 1e-300)), 0.0)

    return np.where(a * n_b > b * n_a, 2 * (part(a, n_a, share) + part(b, n_b, share)), 0.0)


def known_forms(sample: DataFrame) -> list[str]:
    """The forms of the toxic documents, by falling ratio."""
    def run(batches):
        import pyarrow as pa
        count: Counter = Counter()
        for batch in batches:
            for toxic, half, text in zip(*(c.to_pylist() for c in batch.columns)):
                key = 2 * half + toxic
                count[("", key)] += 1  # documents
                count.update((f, key) for f in {f for w in set(LETTERS.findall(lowered(text))) for f in forms_of(w)})
        yield pa.RecordBatch.from_arrays(
            [pa.array([f for f, _ in count], pa.string()), pa.array([k for _, k in count], pa.int32()), pa.array(list(count.values()), pa.int64())], names=["form", "key", "n"])

    df = sample.mapInArrow(run, "form string, key int, n long").groupBy("form").agg(
        *[F.sum(F.when(F.col("key") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(4)])
    total = df.where("form = ''").first()
    if total is None or not all(total[f"n{k}"] for k in range(4)):
        return []
    rows = df.where("form <> '' and n1 >= 2 and n3 >= 2").where(
        (F.col("n1") * total.n0 > MIN_LIFT * F.col("n0") * total.n1) & (F.col("n3") * total.n2 > MIN_LIFT * F.col("n2") * total.n3)).toArrow()
    n = [rows.column(f"n{k}").to_numpy() for k in range(4)]
    least = np.minimum(ratio(n[1], n[0], total.n1, total.n0), ratio(n[3], n[2], total.n3, total.n2))
    forms = rows.column("form").to_pylist()
    return [f for r, f in sorted((-r, f) for r, f in zip(least.tolist(), forms) if r >= MIN_RATIO)][:FORMS]


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of y over x with row weights, by Newton steps."""
    z, c = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ c, -40, 40)))
        g = z.T @ (w * (p - y)) + 0.1 * c * [0, 1]
        h = (z * (w * p * (1 - p))[:, None]).T @ z + 0.1 * np.diag([0.01, 1])
        move = np.linalg.solve(h, g)
        c = c - move * min(1.0, 2 / max(np.abs(move).max(), 1e-12))
    return float(c[0]), float(max(c[1], 0.0))


def fit(docs: DataFrame, labels: DataFrame) -> Field | float:
    """The field, or the constant score where there is nothing to learn."""
    sample, sizes = labelled(docs, labels)
    constant = sizes.get(1, 0) / sum(sizes.values()) if sizes else 0.5
    forms = known_forms(sample)
    if not forms:
        return float(constant)

    def run(batches):
        import pyarrow as pa
        finder = Finder(forms)
        for batch in batches:
            found = [finder.hits(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([[h[2] for h in hits] for hits, _ in found], pa.list_(pa.int32())),
                pa.array([[h[3] for h in hits] for hits, _ in found], pa.list_(pa.list_(pa.int32()))), pa.array([after for _, after in found], pa.int32())],
                names=["toxic", "gaps", "forms", "after"])

    rows = sample.mapInArrow(run, "toxic int, gaps array<int>, forms array<array<int>>, after int").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["toxic"], r["gaps"], r["forms"], r["after"]))  # the same order whatever the tasks
    sequences = []
    for r in rows:
        hits = list(zip(r["gaps"], r["forms"]))
        for at in range(0, len(hits), CHUNK):
            tokens = []
            for gap, known in hits[at:at + CHUNK]:
                tokens += [([], 0)] * min(gap, GAP) + [(known, r["toxic"])]
            sequences.append(tokens + [([], 0)] * min(r["after"], GAP))
    if not sequences:
        return float(constant)
    model = train(sequences, forms)
    y = np.array([r["toxic"] for r in rows])
    mass = np.array([p.sum() for p in marginals(model, [([(0, 0, g, k) for g, k in zip(r["gaps"], r["forms"])], r["after"]) for r in rows])])
    weight = np.where(y == 1, sizes[1] / max(1, y.sum()), sizes[0] / max(1, (1 - y).sum()))
    model.slope = logistic(np.log(mass + SMALL), y, weight / weight.mean())
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and spans (start:end in code
    points, end exclusive, comma-joined) of every row."""
    small_batches(docs.sparkSession)
    model = fit(docs, labels)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), text_or_empty("text").alias("text"))
    if isinstance(model, float):
        return rows.select("doc_id", "held_out", F.lit(model).alias("score"), F.lit(int(model >= threshold)).alias("predicted"), F.lit("").alias("spans"))

    def run(batches):
        import pyarrow as pa
        finder = Finder(model.forms)
        for batch in batches:
            found = [finder.hits(t) for t in batch.column(2).to_pylist()]
            each = marginals(model, found)
            score = model.score_of(np.array([p.sum() for p in each]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32()),
                 pa.array([spans(hits, p) for (hits, _), p in zip(found, each)], pa.string())], names=["doc_id", "held_out", "score", "predicted", "spans"])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, spans string")


def spans(hits: list, p: np.ndarray) -> str:
    """Toxic tokens; those without a word between them are one span."""
    out: list = []
    last = None
    for k in np.flatnonzero(p >= TAG).tolist():
        start, end, gap, _ = hits[k]
        if last == k - 1 and gap == 0 and out:
            out[-1][1] = end
        else:
            out.append([start, end])
        last = k
    return ",".join(f"{a}:{b}" for a, b in out)
