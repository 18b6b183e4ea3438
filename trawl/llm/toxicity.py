"""Toxicity: a word classifier with a counterfactual penalty for identity terms.

Features are the words present in a text and their beginnings of three to six letters (an insult keeps its stem when
its ending varies).  Spark counts, over the labelled rows, in how many texts of either label a feature stands; those
that depart from the share of toxic texts by ``MIN_Z`` standard deviations enter the model, and so do all terms that
name groups.  The loss is the logistic loss, a small ridge, and the *counterfactual penalty*: every labelled text
that names a group is written once more for each other term of the group, and the squared change of its score is
added.  A group name that stands beside insults in the labelled rows thereby gets the weight of its counterparts, not
that of the insults, so neutral mentions stay low.

The model is fitted on at most ``MAX_LABELLED`` labelled documents and keeps at most ``MAX_FEATURES`` features;
scoring is one pass over the whole texts.

Defined results: null and empty texts have no words and get the score of the bias alone; with no labelled document,
or with one class only, the score is the share of label 1 (0 without labels); rows with a null id are scored and
never learned from; repeated rows get equal scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import as_bool_learn, materialize, text_or_empty
from trawl.llm.labelled import learn_sample

MAX_LABELLED = 8_000
MAX_FEATURES = 1_000
MIN_DOCS = 3
MIN_Z = 3.0
STEMS = (3, 4, 5, 6)
RIDGE = 1e-4
#: Words whose features a worker remembers.
CACHE = 200_000
#: Weight of the counterfactual penalty.
COUNTERFACTUAL = 5.0
STEPS = 400
RATE = 0.05
THRESHOLD = 0.7

# Terms that name groups of people; the terms of a line are each other's counterparts.
IDENTITY_TERMS = (
    ("man", "woman"), ("men", "women"), ("male", "female"), ("boy", "girl"), ("he", "she"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "homosexual"), ("transgender", "cisgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"), ("african", "european", "american", "mexican", "chinese", "indian"),
    ("immigrant", "citizen"), ("immigrants", "citizens"), ("young", "old"), ("disabled", "blind", "deaf"),
)
_GROUP = {t: g for g in IDENTITY_TERMS for t in g}
_WORD = re.compile(r"[^\W\d_]+")


def words_in(text: str | None) -> set[str]:
    """The distinct words of a text."""
    text = (text or "").lower()
    if len(text) < 1 << 20:
        return set(_WORD.findall(text))
    out: set[str] = set()
    it = (m.group() for m in _WORD.finditer(text))
    while part := list(islice(it, 1 << 16)):
        out.update(part)
    return out


def counterfactuals(words: set[str]) -> Iterator[set[str]]:
    """The same words with each group term swapped for each of its counterparts."""
    for term in sorted(words & _GROUP.keys()):
        for other in _GROUP[term]:
            if other != term:
                yield (words - {term}) | {other}


def features(word: str) -> list[str]:
    """The word and its beginnings."""
    return [word, *(word[:n] + "-" for n in STEMS if len(word) >= n)]


class _Known(dict):
    """Word -> those of its features that are in the model, remembered."""

    def __init__(self, number: dict[str, int]):
        super().__init__()
        self.number = number

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > CACHE:
            self.clear()
        self[word] = out = tuple(self.number[f] for f in features(word) if f in self.number)
        return out

    def of(self, words: set[str]) -> list[int]:
        """The features of a text, in order."""
        return sorted({f for w in words for f in self[w]})


class Model:
    """A bias and the weights of some features."""

    def __init__(self, bias: float, weights: dict[str, float]):
        self.bias, self.weights = bias, weights
        self._known: _Known | None = None

    def score(self, text: str | None) -> float:
        if self._known is None:
            self._names = sorted(self.weights)
            self._known = _Known({f: k for k, f in enumerate(self._names)})
            self._values = [self.weights[f] for f in self._names]
        z = self.bias + sum(self._values[k] for k in self._known.of(words_in(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    @classmethod
    def constant(cls, share: float) -> Model:
        return cls(float(np.clip(np.log(max(share, 1e-12)) - np.log(max(1 - share, 1e-12)), -500, 500)), {})


class _Sparse:
    """Rows of feature numbers."""

    def __init__(self, rows: list[list[int]], width: int):
        self.at = np.array([i for r in rows for i in r], np.int64)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows]).astype(np.int64)
        self.n, self.width = len(rows), width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, r[self.row], self.width)


def telling(counts: list[tuple[str, int, int]], n: int, toxic: int, most: int = MAX_FEATURES) -> list[str]:
    """The features (feature, texts, toxic texts) that depart most from the share of toxic texts, and group terms."""
    share = toxic / max(1, n)
    z = {f: (k - m * share) / (m * share * (1 - share) + 1) ** 0.5 for f, m, k in counts if m >= MIN_DOCS}
    best = sorted((f for f, v in z.items() if abs(v) >= MIN_Z), key=lambda f: (-abs(z[f]), f))[:most]
    groups = {t for f, _, _ in counts if f in _GROUP for t in _GROUP[f]}
    return sorted({*best, *groups})


def fit(rows: list[list[int]], y: np.ndarray, pairs: list[tuple[list[int], list[int]]], names: list[str],
        penalty: float = COUNTERFACTUAL) -> Model:
    """Adam on the penalised loss; both classes weigh the same.  ``pairs`` are texts and their counterfactuals."""
    if not len(y) or y.min() == y.max():
        return Model.constant(float(y.mean()) if len(y) else 0.0)
    x, a, b = (_Sparse(r, len(names)) for r in (rows, [p for p, _ in pairs], [c for _, c in pairs]))
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = np.zeros(len(names) + 1)  # the bias stands last
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x.dot(w[:-1]) + w[-1], -50, 50)))
        r = weight * (p - y) / len(y)
        g = np.append(x.back(r) + RIDGE * w[:-1], r.sum())
        if pairs:
            d = a.dot(w[:-1]) - b.dot(w[:-1])
            g[:-1] += 2 * penalty / len(pairs) * (a.back(d) - b.back(d))
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return Model(float(w[-1]), dict(zip(names, w[:-1].tolist())))


def fit_texts(texts: list[str], y: np.ndarray, penalty: float = COUNTERFACTUAL) -> Model:
    """The same fit on texts in memory."""
    seen: Counter[str] = Counter()
    toxic: Counter[str] = Counter()
    bags = [words_in(t) for t in texts]
    for bag, label in zip(bags, y):
        found = {f for w in bag for f in features(w)}
        seen.update(found)
        toxic.update(found if label > 0 else ())
    names = telling([(f, n, toxic[f]) for f, n in seen.items()], len(y), int((y > 0).sum()))
    known = _Known({f: k for k, f in enumerate(names)})
    return fit([known.of(b) for b in bags], y, [(known.of(b), known.of(c)) for b in bags for c in counterfactuals(b)],
               names, penalty)


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MAX_LABELLED,
                    penalty: float = COUNTERFACTUAL) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    sample = learn_sample(docs, labels, label, most)

    def counted(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        toxic: Counter[str] = Counter()
        for pdf in it:
            for text, y in zip(pdf["text"], pdf["label"]):
                found = {f for w in words_in(text) for f in features(w)}
                found.add("")  # the empty feature counts the texts
                seen.update(found)
                toxic.update(found if y > 0 else ())
        yield pd.DataFrame([(f, n, toxic[f]) for f, n in seen.items()], columns=["feature", "n", "k"])

    counts = sample.mapInPandas(counted, "feature string, n long, k long") \
        .groupBy("feature").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    counts = materialize(counts, "toxic-features")
    whole = counts.filter("feature = ''").first()
    n, toxic = (whole["n"], whole["k"]) if whole else (0, 0)
    share = toxic / max(1, n)
    z = F.abs((F.col("k") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share) + 1))
    # at most MAX_FEATURES rows, and the group terms
    top = counts.filter((F.col("n") >= MIN_DOCS) & (z >= MIN_Z) & (F.col("feature") != "")) \
        .orderBy(F.desc(z), "feature").limit(MAX_FEATURES)
    named = counts.filter(F.col("feature").isin(sorted(_GROUP)))
    names = telling([tuple(r) for r in top.unionByName(named).distinct().collect()], n, toxic)
    number = {f: k for k, f in enumerate(names)}

    def listed(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Known(number)
        for pdf in it:
            bags = [words_in(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "own": [known.of(b) for b in bags],
                                "others": [[known.of(c) for c in counterfactuals(b)] for b in bags]})

    rows = sample.mapInPandas(listed, "doc_id long, label int, own array<int>, others array<array<int>>") \
        .orderBy("doc_id").collect()
    model = fit([list(r["own"]) for r in rows], np.array([float(r["label"] > 0) for r in rows]),
                [(list(r["own"]), list(c)) for r in rows for c in r["others"]], names, penalty)
    bias, weights = model.bias, model.weights

    def scored(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(bias, weights)
        for pdf in it:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"],
                                "score": np.array([own.score(t) for t in pdf["text"]], np.float64)})

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~as_bool_learn(F.col("doc_id"))).alias("held_out"),
                      text_or_empty("text").alias("text")) \
        .mapInPandas(scored, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
