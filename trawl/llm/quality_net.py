"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

1. Every token type has a sparse ternary index vector made from a hash.  The context vector of a word is the sum of
   the index vectors of its neighbours over *all* documents: each task adds up integers in one table of ``BUCKETS``
   hashed words, and Spark sums the tables (exact, so the order of tasks does not matter).
2. A token carries its word and its shape (lower, title, upper case, digits, symbols, same as the token before).
3. A document is the mean of its words' unit context vectors, beside the mean of their index vectors.
4. A two-layer numpy network is fitted on at most ``MAX_LABELLED`` labelled documents, without a fifth of them that
   then sets the temperature of the probabilities.

The model (word table and network) has a fixed size and is handed to the tasks; scoring is one pass.

Defined results: null and empty texts have the zero vector and get its score; with no labelled document, or with
one class only, the score is the share of label 1 (one half without labels); rows with a null id are scored and are
never learned from; repeated rows get equal scores.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import as_bool_learn, text_or_empty
from trawl.llm.labelled import learn_sample

BUCKETS = 8_192
SHAPES = 8
DIM = 32
NONZERO = 4
MAX_LABELLED = 6_000
HIDDEN = 32
EPOCHS = 400
CACHE = 200_000
#: Tokens whose contexts are added up at a time.
PIECE = 1 << 18
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")


def _shape(token: str) -> int:
    if not token[0].isalnum():
        return 5 if len(token) == 1 else 6
    if token.isdigit():
        return 4
    if token.isupper() and len(token) > 1:
        return 3
    return 1 if token.islower() else 2


class _Types(dict):
    """Token -> bucket * SHAPES + shape, remembered."""

    def __missing__(self, token: str) -> int:
        if len(self) > CACHE:
            self.clear()
        word = zlib.crc32(token.lower().encode("utf-8", "surrogatepass")) % BUCKETS
        self[token] = out = word * SHAPES + _shape(token)
        return out


def index_vectors() -> np.ndarray:
    """The index vector of every type (int8): that of its word plus that of its shape."""
    rng = np.random.default_rng(20_240_601)

    def ternary(rows: int) -> np.ndarray:
        out = np.zeros((rows, DIM), np.int8)
        for k in range(NONZERO):
            at = rng.integers(0, DIM // NONZERO, rows) + k * (DIM // NONZERO)
            out[np.arange(rows), at] = rng.integers(0, 2, rows) * 2 - 1
        return out
    words, shapes = ternary(BUCKETS), ternary(SHAPES)
    return (words[:, None, :] + shapes[None, :, :]).reshape(-1, DIM)


def token_types(text: str, types: _Types) -> np.ndarray:
    """The type of each token; a token equal to the one before has the shape 7."""
    tokens = _TOKEN.findall(text)
    out = np.fromiter(map(types.__getitem__, tokens), np.int64, len(tokens))
    same = np.flatnonzero(out[1:] == out[:-1]) + 1
    out[same] = out[same] // SHAPES * SHAPES + 7
    return out


def context_table(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The context vector of every bucket, over all documents."""
    def partial(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, types = index_vectors(), _Types()
        place = np.argsort(-np.abs(index), axis=1, kind="stable")[:, :2 * NONZERO]
        sign = np.take_along_axis(index, place, axis=1).astype(np.float64)
        table = np.zeros(BUCKETS * DIM, np.int64)
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []
        size = 0

        def add() -> None:
            if not left:
                return
            a, b = np.concatenate(left), np.concatenate(right)
            for word, near in ((a, b), (b, a)):
                base = word // SHAPES * DIM
                for k in range(2 * NONZERO):
                    table[:] += np.bincount(base + place[near, k], sign[near, k], BUCKETS * DIM).astype(np.int64)

        for pdf in it:
            for text in pdf["text"]:
                t = token_types(text, types)
                for at in range(0, len(t) - 1, PIECE):
                    part = t[at:at + PIECE + 1]
                    left.append(part[:-1])
                    right.append(part[1:])
                    size += len(part)
                    if size >= PIECE:
                        add()
                        left, right, size = [], [], 0
        add()
        table = table.reshape(BUCKETS, DIM)
        seen = np.flatnonzero(table.any(axis=1))
        yield pd.DataFrame({"bucket": seen, **{f"v{k}": table[seen, k] for k in range(DIM)}})

    schema = "bucket int, " + ", ".join(f"v{k} long" for k in range(DIM))
    rows = docs.select(text_or_empty(f"`{text_col}`").alias("text")).mapInPandas(partial, schema) \
        .groupBy("bucket").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(DIM)])
    # one row per bucket: a fixed number
    found = rows.toPandas().to_numpy(np.float64)
    table = np.zeros((BUCKETS, DIM))
    table[found[:, 0].astype(np.int64)] = found[:, 1:]
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(text: str, types: _Types, context: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The vector of a document."""
    out = np.zeros(2 * DIM, np.float64)
    t = token_types(text, types)
    for at in range(0, len(t), PIECE):
        part = t[at:at + PIECE]
        out[:DIM] += context[part // SHAPES].sum(axis=0)
        out[DIM:] += index[part].sum(axis=0)
    return out / max(1, len(t))


class Net:
    """input -> tanh -> logit, with standardised inputs and a temperature."""

    def __init__(self, dim: int, prior: float):
        self.prior, self.mean, self.std = prior, np.zeros(dim), np.ones(dim)
        self.weights: list[np.ndarray] | None = None
        self.temperature = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh((x - self.mean) / self.std @ w1 + b1) @ w2 + b2[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, held: np.ndarray) -> Net:
        """Adam on the rows not in ``held``; the temperature minimises the loss of those in ``held``."""
        net = cls(x.shape[1], float(y.mean()) if len(y) else 0.5)
        if len(y) < 10 or y.min() == y.max():
            return net
        fit = ~held if 0 < held.sum() < len(y) and len(set(y[~held])) == 2 else np.ones(len(y), bool)
        xf, yf = x[fit], y[fit]
        net.mean, net.std = xf.mean(axis=0), xf.std(axis=0) + 1e-6
        rng = np.random.default_rng(7)
        net.weights = w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
                           rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
        first, second = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
        z, decay, rate = (xf - net.mean) / net.std, 1e-3, 0.01
        for step in range(1, EPOCHS + 1):
            hidden = np.tanh(z @ w[0] + w[1])
            p = 1 / (1 + np.exp(-np.clip(hidden @ w[2] + w[3][0], -50, 50)))
            d = (p - yf) / len(yf)
            dh = d[:, None] * w[2] * (1 - hidden ** 2)
            grads = [z.T @ dh + decay * w[0], dh.sum(axis=0), hidden.T @ d + decay * w[2], np.array([d.sum()])]
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] -= rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
        at = held if not fit.all() else fit
        logits, grid = net.logits(x[at]), np.geomspace(0.25, 8, 60)
        loss = [np.logaddexp(0, np.where(y[at] > 0, -logits, logits) / t).mean() for t in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
        return net


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality",
                   most: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    context = context_table(docs)

    def vectors(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, types = index_vectors(), _Types()
        for pdf in it:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"],
                                "x": [pooled(t, types, context, index) for t in pdf["text"]]})

    rows = learn_sample(docs, labels, label, most) \
        .mapInPandas(vectors, "doc_id long, label int, x array<double>").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    x = np.array(rows["x"].tolist(), np.float64).reshape(-1, 2 * DIM)
    held = np.array([zlib.crc32(f"calibration {i}".encode()) % 5 == 0 for i in rows["doc_id"]], bool)
    net = Net.fit(x, (rows["label"].to_numpy(np.float64) > 0).astype(np.float64), held)

    def scored(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, types = index_vectors(), _Types()
        for pdf in it:
            v = np.array([pooled(t, types, context, index) for t in pdf["text"]]).reshape(-1, 2 * DIM)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": net.scores(v)})

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~as_bool_learn(F.col("doc_id"))).alias("held_out"),
                      text_or_empty("text").alias("text")) \
        .mapInPandas(scored, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
