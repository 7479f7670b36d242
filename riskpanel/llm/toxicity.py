"""Toxic spans by a linear-chain conditional random field.

Two states a token (clean, toxic). Emissions are sums of weights of hashed features (the word and its prefixes), so a
token costs a few look-ups in a table of fixed size; transitions are a 2 x 2 matrix. The model is fitted in numpy on a
bounded sample of labelled documents, whose tokens are labelled first: a token of a toxic document is toxic when one of
its features is much commoner in toxic than in clean documents.

Scoring runs forward-backward over all tokens of a block of texts at once: the recursions are products of 2 x 2
matrices, a text's first token forgets what stood before, and the products are taken for many stretches side by side
before the stretches are chained. The marginals give a document's score and its offending offsets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskpanel.llm import textkit as tk

FEATURE_BITS = 22
LEAST_DOCS = 3  # features of fewer training documents have no weight
BIAS = -5.0  # log odds of a token that has no known feature
PREFIXES = (4, 5, 6, 8)
TRAIN_ROWS = 1500  # documents of each label
TRAIN_CHARS = 6_000_000  # characters of each label's documents, all together
SPAN_AT = 0.5
PREDICT_AT = 0.7
_STRETCH = 64
_STRIP = np.zeros(256, bool)
_STRIP[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


class Model:
    """weights: a number for each feature bucket (sent as the few that are not zero); trans[a, b]: from state a to b; first: of a text's first token;
    doc: bias and weights of a document's largest marginal and of log(1 + their sum)."""

    def __init__(self):
        self.weights = np.zeros(1 << FEATURE_BITS, np.float32)
        self.bias = BIAS
        self.trans = np.zeros((2, 2))
        self.first = np.zeros(2)
        self.doc = np.array([-4.0, 8.0, 0.0])

    def __getstate__(self):
        at = np.flatnonzero(self.weights)
        return self.__dict__ | {"weights": (at.astype(np.int32), self.weights[at])}

    def __setstate__(self, state):
        at, values = state["weights"]
        self.__dict__.update(state)
        self.weights = np.zeros(1 << FEATURE_BITS, np.float32)
        self.weights[at] = values


def token_features(block: tk.Block):
    """Bounds of the tokens in bytes, the texts' bounds among them, and their features (tokens x kinds)."""
    low = tk.LOWER[block.data]
    s, e, wb = block.words(low)
    n = len(s)
    core_e = e.copy()
    for _ in range(3):  # without punctuation at the end
        core_e -= (core_e - s > 1) & _STRIP[low[np.maximum(core_e - 1, 0)]] if n else 0
    out = np.empty((n, 1 + len(PREFIXES)), np.int32)
    shift = np.uint64(64 - FEATURE_BITS)
    out[:, 0] = (tk.span_hashes(low, s, core_e) >> shift).astype(np.int32)
    for c, k in enumerate(PREFIXES, 1):
        h = tk.span_hashes(low, s, np.minimum(s + k, core_e))
        with np.errstate(over="ignore"):
            out[:, c] = (tk.mix64(h + tk.CODES[c]) >> shift).astype(np.int32)
    return s, e, wb, out


def _matrices(u: np.ndarray, starts: np.ndarray, model: Model) -> list[np.ndarray]:
    """The four entries of every token's matrix, laid out by place in the stretch, then by stretch."""
    n = len(u)
    cols = _STRETCH
    rows = -(-n // cols)
    x = np.exp(np.clip(u, -30, 30))
    a = np.exp(model.trans)
    m = [np.full(n, a[0, 0]), a[0, 1] * x, np.full(n, a[1, 0]), a[1, 1] * x]
    f = np.exp(model.first)
    for k in (0, 2):
        m[k][starts] = f[0]
    for k in (1, 3):
        m[k][starts] = f[1] * x[starts]
    out = []
    for k, v in enumerate(m):
        full = np.full(rows * cols, 1.0 if k in (0, 3) else 0.0)
        full[:n] = v
        out.append(np.ascontiguousarray(full.reshape(rows, cols).T))
    return out


def marginals(u: np.ndarray, bounds: np.ndarray, model: Model) -> np.ndarray:
    """P(toxic) of every token given all of its text; u: the tokens' emission, toxic against clean."""
    n = len(u)
    if not n:
        return np.zeros(0)
    starts = np.unique(bounds[:-1][np.diff(bounds) > 0])
    m00, m01, m10, m11 = _matrices(u, starts, model)
    cols, rows = m00.shape
    p00, p01, p10, p11 = (x[0].copy() for x in (m00, m01, m10, m11))
    for c in range(1, cols):
        q00, q01 = p00 * m00[c] + p01 * m10[c], p00 * m01[c] + p01 * m11[c]
        q10, q11 = p10 * m00[c] + p11 * m10[c], p10 * m01[c] + p11 * m11[c]
        top = np.maximum(np.maximum(q00, q01), np.maximum(q10, q11))
        p00, p01, p10, p11 = q00 / top, q01 / top, q10 / top, q11 / top
    # the share of the toxic state before each stretch, and the share of its backward value after it
    into, after = np.empty(rows), np.empty(rows)
    l00, l01, l10, l11 = (x.tolist() for x in (p00, p01, p10, p11))
    v = 0.5
    for r in range(rows):
        into[r] = v
        a, b = (1 - v) * l00[r] + v * l10[r], (1 - v) * l01[r] + v * l11[r]
        v = b / (a + b)
    v = 0.5
    for r in range(rows - 1, -1, -1):
        after[r] = v
        a, b = l00[r] * (1 - v) + l01[r] * v, l10[r] * (1 - v) + l11[r] * v
        v = b / (a + b)
    alpha, beta = np.empty((cols, rows)), np.empty((cols, rows))
    v = into
    for c in range(cols):
        a, b = (1 - v) * m00[c] + v * m10[c], (1 - v) * m01[c] + v * m11[c]
        v = b / (a + b)
        alpha[c] = v
    v = after
    for c in range(cols - 1, -1, -1):
        beta[c] = v
        a, b = m00[c] * (1 - v) + m01[c] * v, m10[c] * (1 - v) + m11[c] * v
        v = b / (a + b)
    on, off = alpha * beta, (1 - alpha) * (1 - beta)
    return (on / (on + off)).T.ravel()[:n]


def emissions(features: np.ndarray, model: Model) -> np.ndarray:
    u = np.full(len(features), model.bias, np.float64)
    for c in range(features.shape[1]):
        u += model.weights[features[:, c]]
    return u


def _document_inputs(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    n = len(bounds) - 1
    top = np.zeros(n)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        top[full] = np.maximum.reduceat(p, bounds[:-1][full])
    return np.stack([np.ones(n), top, np.log1p(tk.per_text(p, bounds))], 1)


def label_tokens(features: np.ndarray, bounds: np.ndarray, toxic: np.ndarray, odds: float = 8.0) -> np.ndarray:
    """Token labels from document labels: a token of a toxic document is toxic when one of its features is at least
    ``odds`` times as common in toxic as in clean documents, by more than chance explains over all features tried (a
    likelihood ratio test whose level falls with their number)."""
    doc = tk.owners(bounds)
    bad = np.zeros(len(features), bool)
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    size = 1 << FEATURE_BITS

    def gain(d, n, p):
        return d * np.log(np.maximum(p, 1e-12)) + (n - d) * np.log(np.maximum(1 - p, 1e-12))

    for c in range(features.shape[1]):
        seen = np.unique(doc * size + features[:, c])
        t = toxic[seen // size]
        f, at = np.unique(seen % size, return_inverse=True)
        d1, d0 = np.bincount(at[t], minlength=len(f)), np.bincount(at[~t], minlength=len(f))
        tried = max(1, int((d1 + d0 >= 4).sum()))
        g = gain(d1, n1, d1 / n1) + gain(d0, n0, d0 / n0) - gain(d1 + d0, n1 + n0, (d1 + d0) / (n1 + n0))
        strong = (g > np.log(tried) + 1) & ((d1 + 0.5) / n1 >= odds * (d0 + 0.5) / n0)
        bad |= np.isin(features[:, c], f[strong])
    return bad & toxic[doc]


def without_copies(texts: list, toxic: list) -> tuple[list, list]:
    """The texts without exact and near copies (any of four min-hashes of the word trigrams in common): copies of one
    toxic document would make all of its words look toxic."""
    kept, seen, k = [], set(), 0
    for block in tk.blocks(pa.array(texts, pa.string())):
        s, e, wb = block.words(tk.LOWER[block.data])
        h = tk.span_hashes(tk.LOWER[block.data], s, e)
        for i in range(block.n):
            g = tk.gram_hashes(h[wb[i]: wb[i + 1]], min(3, max(1, int(wb[i + 1] - wb[i]))))
            sign = {(c, int(tk.mix64(g ^ tk.CODES[c]).min())) for c in range(4)} if len(g) else {(-1, 0)}
            if not sign & seen:
                kept.append(k)
            seen |= sign
            k += 1
    return [texts[i] for i in kept], [toxic[i] for i in kept]


def fit(texts: list, toxic: list, rounds: int = 25, rate: float = 0.5) -> Model:
    """Fits by full-batch adaptive gradients of the token likelihood, then a logistic score of documents."""
    model = Model()
    texts, toxic = without_copies(texts, toxic)
    toxic = np.asarray(toxic, bool)
    feats, bounds = [], [np.zeros(1, np.int64)]
    for block in tk.blocks(pa.array(texts, pa.string())):
        _, _, wb, f = token_features(block)
        feats.append(f)
        bounds.append(wb[1:] + bounds[-1][-1])
    if not feats or not toxic.any() or toxic.all():
        return model
    f, b = np.concatenate(feats), np.concatenate(bounds)
    y = label_tokens(f, b, toxic)
    full = np.diff(b) > 0
    first = b[:-1][full]
    before = np.ones(len(y), bool)
    before[first] = False
    prev = np.concatenate([[0], y[:-1]]).astype(int)
    # transitions: smoothed counts of the labelled sequences; emissions: gradient of the sequence likelihood
    pairs = np.bincount((prev * 2 + y)[before], minlength=4).reshape(2, 2) + 1.0
    model.trans = np.log(pairs / pairs.sum(1, keepdims=True))
    start = np.bincount(y[first].astype(int), minlength=2) + 1.0
    model.first = np.log(start / start.sum())
    size, used = len(model.weights), []
    for c in range(f.shape[1]):
        seen, docs_of = np.unique(np.unique(tk.owners(b) * size + f[:, c]) % size, return_counts=True)
        used.append(seen[docs_of >= LEAST_DOCS])
    used = np.unique(np.concatenate(used))
    place = np.full(len(model.weights), len(used), np.int32)  # the last place takes what has no weight
    place[used] = np.arange(len(used), dtype=np.int32)
    flat = place[f]
    w, past = np.zeros(len(used)), np.full(len(used), 1e-6)
    for _ in range(rounds):
        model.weights[used] = w
        g = y - marginals(emissions(f, model), b, model)
        grad = np.zeros(len(used))
        for c in range(f.shape[1]):
            grad += np.bincount(flat[:, c], weights=g, minlength=len(used) + 1)[:-1]
        grad -= 0.02 * w
        past += grad ** 2
        w += rate * grad / np.sqrt(past)
    model.weights[used] = w
    x = _document_inputs(marginals(emissions(f, model), b, model), b)
    t, theta = toxic.astype(float), np.zeros(3)
    balance = np.where(toxic, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (~toxic).sum()))
    for _ in range(30):  # Newton steps of a ridge logistic regression, classes weighted alike
        q = 1 / (1 + np.exp(-x @ theta))
        h = (x * (balance * q * (1 - q))[:, None]).T @ x + 1e-4 * np.eye(3)
        theta = theta + np.linalg.solve(h, x.T @ (balance * (t - q)) - 1e-4 * theta)
    model.doc = theta
    return model


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS):
    """At most ``rows`` documents of each label outside the held-out third, those with the smallest hash of the id, as many
    as have ``chars`` characters in all (the first one, whatever its length). Ids with null or conflicting labels are left
    out."""
    known = (labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
             .where(~held_out(F.col("doc_id"), 3, 1)))
    few = None
    for value in (0, 1):
        part = known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows * 3 // 2)
        few = part if few is None else few.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "text")  # at most 3 * rows ids
    got = (texts.join(F.broadcast(few), "doc_id").withColumn("upto", F.sum(F.length("text")).over(order))
           .where((F.col("upto") <= chars) | (F.col("upto") == F.length("text"))).select("toxic", "doc_id", "text").toArrow())
    got = set(zip(*(got.column(c).to_pylist() for c in range(3)), strict=True))
    got = sorted(got, key=lambda r: (r[0], _spread(r[1]), r[2]))
    zero, one = [r for r in got if r[0] == 0][:rows], [r for r in got if r[0] == 1][:rows]
    return [r[2] for r in zero + one], [r[0] == 1 for r in zero + one]


def _spread(doc_id: int) -> int:
    with np.errstate(over="ignore"):
        return int(tk.mix64(np.array([doc_id], np.int64).view(np.uint64))[0])


def held_out(doc_id, parts: int, which: int):
    """crc32 of the id as text modulo ``parts`` is ``which``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == which, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    return fit(*training_rows(docs, labels, rows, chars))


def score(docs: DataFrame, model: Model, spans: bool = True, name: str = "score") -> DataFrame:
    """``docs`` with ``name`` (0 to 1) and, if wanted, spans: byte offsets of maximal runs of tokens that are toxic with
    probability ``SPAN_AT`` or more. A text without tokens (null, empty, blank) has the score of a document without
    toxic tokens and no span. Repeated rows score alike. Only the text is read."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(block: tk.Block) -> dict:
        s, e, wb, f = token_features(block)
        p = marginals(emissions(f, sent.value), wb, sent.value)
        x = _document_inputs(p, wb) @ sent.value.doc
        out = {name: 1 / (1 + np.exp(-np.clip(x, -50, 50)))}
        if spans:
            doc, hit = tk.owners(wb), p >= SPAN_AT
            new = hit.copy()
            new[1:] &= ~(hit[:-1] & (doc[1:] == doc[:-1]))
            end = hit.copy()
            end[:-1] &= ~(hit[1:] & (doc[1:] == doc[:-1]))
            a, b = np.flatnonzero(new), np.flatnonzero(end)
            base = block.off[doc[a]]
            flat = pa.StructArray.from_arrays([pa.array(s[a] - base), pa.array(e[b] - base)], ["lo", "hi"])
            out["spans"] = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[a], np.arange(block.n + 1)).astype(np.int32)), flat)
        return out

    return tk.add_columns(docs, "text", {name: "double"} | ({"spans": "array<struct<lo: bigint, hi: bigint>>"} if spans else {}), run)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = PREDICT_AT) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, judged where they lie; all columns."""
    return score(docs, train(docs, labels), spans=False, name="__toxic").where(F.col("__toxic") < threshold).drop("__toxic")
