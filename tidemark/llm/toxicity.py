"""Toxicity by multiple-instance learning over sentences.

Only documents carry labels.  Each sentence *s* gets a probability
``p_s = sigmoid(bias + sum of weights of the features in s)`` and a document is
toxic if any sentence is: ``P = 1 - prod(1 - p_s)`` (noisy-or).  The weights are
fitted to document labels through that formula, so blame settles on the
sentences that toxic documents have and clean ones lack; those are the ones
``locate`` reports.  A sentence without a feature is left out of the product when texts
are scored, so that no number of them makes a text toxic.

Features are the lower-cased word and its prefixes of 4 to 6 bytes, kept if
labelled toxic documents hold them more often than chance explains.  The fit runs on a bounded sample of
labelled rows; scoring reads every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import Adam, labelled_texts, map_texts, sigmoid

#: Labelled texts of each class that the fit may hold, and bytes of one of them.
PER_CLASS, MAX_BYTES = 2000, 20_000
#: Features the model may hold, and documents of the sample that must have one.
MAX_FEATURES, MIN_DOCUMENTS = 20_000, 3
#: A sentence without an end is cut after this many words.
SENTENCE_WORDS = 40
#: What a sentence has against it before its features count: many weak ones stay clean together.
HIGHEST_BIAS = -11.0
#: Words whose weight a task remembers.
CACHE = 150_000
#: A sentence at least this probable is reported as offending.
OFFENDING = 0.5

#: Lower-cases A-Z and blanks all but word bytes and sentence ends; keeps offsets.
_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() or c in b"'.!?\n" else 32
    for c in range(256)
)
_BLANK_ENDS = bytes(32 if c in b".!?\n" else c for c in range(256))
_SENTENCE = re.compile(rb"[^.!?\n]+")
_WORD = re.compile(rb"\S+")

OUTPUTS = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField("n_sentences", T.LongType()),
        T.StructField(
            "offending",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("start", T.LongType()),
                        T.StructField("end", T.LongType()),
                        T.StructField("p", T.DoubleType()),
                    ]
                )
            ),
        ),
    ]
)


@dataclass
class Model:
    bias: float
    weights: dict[bytes, float]


def sentences(text: bytes) -> list[tuple[int, int, list[bytes]]]:
    """Byte range and lower-cased words of each sentence that has a word."""
    found, plain = [], text.translate(_PLAIN)
    for m in _SENTENCE.finditer(plain):
        words = m.group().split()
        if len(words) <= SENTENCE_WORDS:
            if words:
                found.append((m.start(), m.end(), words))
        else:
            spans = [w.span() for w in _WORD.finditer(plain, m.start(), m.end())]
            for k in range(0, len(words), SENTENCE_WORDS):
                part = spans[k : k + SENTENCE_WORDS]
                found.append((part[0][0], part[-1][1], words[k : k + SENTENCE_WORDS]))
    return found


def n_sentences(text: bytes) -> int:
    """How many sentences :func:`sentences` cuts, without their places."""
    sizes = (len(s.split()) for s in _SENTENCE.findall(text.translate(_PLAIN)))
    return sum(-(-n // SENTENCE_WORDS) for n in sizes)


def features(word: bytes) -> list[bytes]:
    """The word itself and its prefixes; a prefix ends in ``*``."""
    return [word, *(word[:k] + b"*" for k in (4, 5, 6) if len(word) >= k)]


def fit(sample: list[tuple[bytes, object]], steps: int = 300, rate: float = 0.1) -> Model:
    """Weights for (text, 0 or 1) rows; without both classes, a constant score.

    As when texts are scored, only sentences with a feature enter the noisy-or.  A sample of no rows scores 0.5; one class only scores near that class.
    """
    truth = np.array([float(y) for _, y in sample])
    if len(set(truth)) < 2:
        return Model(0.0 if not len(truth) else (8.0 if truth[0] else -16.0), {})
    holds: dict[float, Counter] = {0.0: Counter(), 1.0: Counter()}
    for y in (1.0, 0.0):  # features that no toxic text has are not counted
        for (text, _), own in zip(sample, truth, strict=True):
            if own == y:
                words = {w for _, _, ws in sentences(text) for w in ws}
                found = {f for w in words for f in features(w)}
                holds[y].update(found if y else found & holds[1.0].keys())
        holds[y] = Counter({f: n for f, n in holds[y].items() if y == 0 or n >= MIN_DOCUMENTS})
    n1, n0 = truth.sum(), len(truth) - truth.sum()
    names = list(holds[1.0])
    have1 = np.array([holds[1.0][f] for f in names], dtype=float)
    have0 = np.array([holds[0.0][f] for f in names], dtype=float)
    pooled = (have1 + have0) / (n1 + n0)
    contrast = (have1 / n1 - have0 / n0) / np.sqrt(
        np.maximum(pooled * (1 - pooled) * (1 / n1 + 1 / n0), 1e-12)
    )
    # beyond what the largest of so many features without effect would show
    least = np.sqrt(2 * np.log(max(len(names), 2)))
    order = np.argsort(-contrast, kind="stable")[:MAX_FEATURES]
    index = {names[k]: i for i, k in enumerate(order[contrast[order] >= least])}

    ids, sizes, per_doc = [], [], []
    for text, _ in sample:
        before = len(sizes)
        for _, _, words in sentences(text):
            if have := {index[f] for w in words for f in features(w) if f in index}:
                ids.extend(sorted(have))
                sizes.append(len(have))
        per_doc.append(len(sizes) - before)
    ids, sizes, per_doc = (np.array(x, dtype=np.int64) for x in (ids, sizes, per_doc))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    doc_of = np.repeat(np.arange(len(per_doc)), per_doc)
    share = np.where(truth > 0, 0.5 / n1, 0.5 / n0)
    weights = np.zeros(len(index))
    bias = np.array([HIGHEST_BIAS])
    step = Adam([weights, bias], rate)
    for _ in range(steps):
        z = bias[0] + np.bincount(owner, weights[ids], minlength=len(sizes))
        total = np.bincount(doc_of, np.logaddexp(0, z), minlength=len(truth))
        blame = np.where(truth > 0, -1.0 / np.expm1(np.clip(total, 1e-6, 60)), 1.0) * share
        slope = blame[doc_of] * sigmoid(z)
        step(
            [
                np.bincount(ids, slope[owner], minlength=len(index)) + 1e-5 * weights,
                np.array([slope.sum()]),
            ]
        )
        bias[0] = min(bias[0], HIGHEST_BIAS)
    kept = {f: float(weights[i]) for f, i in index.items() if abs(weights[i]) > 1e-3}
    return Model(float(bias[0]), kept)


def scorer(model: Model):
    """A function from texts to scores, sentence counts and offending sentences."""
    weights = model.weights

    class Remembered(dict):
        def __missing__(self, word: bytes) -> tuple[bytes, ...]:
            if len(self) >= CACHE:
                self.clear()
            self[word] = found = tuple(f for f in features(word) if f in weights)
            return found

    known = Remembered()

    def work(texts: list[bytes | None]) -> list[list]:
        scores, counts, places = [], [], []
        for text in texts:
            text, found = text or b"", []
            words = set(text.translate(_PLAIN).translate(_BLANK_ENDS).split())
            if any(map(known.__getitem__, words)):
                parts = sentences(text)
                z = np.full(len(parts), -np.inf)
                for k, (_, _, own) in enumerate(parts):
                    have = {f for fs in map(known.__getitem__, own) if fs for f in fs}
                    if have:
                        z[k] = model.bias + sum(weights[f] for f in sorted(have))
                n, total, p = len(parts), float(np.logaddexp(0, z).sum()), sigmoid(z)
                for k in np.flatnonzero(p >= OFFENDING):
                    found.append({"start": parts[k][0], "end": parts[k][1], "p": float(p[k])})
            else:
                n = n_sentences(text)
                # a model without features is a constant score; else nothing speaks against the text
                total = 0.0 if weights else n * float(np.logaddexp(0, model.bias))
            scores.append(float(-np.expm1(-total)))
            counts.append(n)
            places.append(found)
        return [scores, counts, places]

    return work


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id",
          text: str = "text") -> Model:
    """Fit on at most ``PER_CLASS`` labelled texts of each class."""
    return fit(labelled_texts(docs, labels, label, key, text, PER_CLASS, MAX_BYTES, [0, 1]))


def locate(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Score every text and list its offending sentences as byte ranges.

    Null and empty texts have no sentence and score 0.  Each row is scored on its
    own, so repeated rows repeat their result; only the columns in ``keep`` pass
    through, so other columns cannot clash.
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(model)  # at most MAX_FEATURES weights
    return map_texts(docs, keep, text, OUTPUTS, _start, shared)


def _start(shared):
    return scorer(shared.value)
