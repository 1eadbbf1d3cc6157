"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words.  Every passage is
encoded from what it looks like: the shares of byte-class pairs (lower, upper,
digit, each common mark, ...), repetition and word length.  A learned layer gives
``h_k = tanh(W x_k + b)``, gated attention weighs the passages,
``a = softmax(w . (tanh(V h) * sigmoid(U h)))``, and the weighted passage
``sum a_k h_k`` is scored by a logistic layer.  All of it is fitted to document
labels in numpy on a bounded sample of labelled rows; scoring reads every whole
text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import Adam, keep_rows, labelled_texts, map_texts, ranges, sigmoid

#: Labelled texts of each class that the fit may hold, and bytes of one of them.
PER_CLASS, MAX_BYTES = 1000, 20_000
PASSAGE_WORDS, HIDDEN, GATE = 64, 24, 12
#: Words encoded at once, in whole passages.
PIECE_WORDS = PASSAGE_WORDS * 1000
#: A document is kept by a filter from this score on.
KEEP = 0.3

#: Byte classes: one for each mark listed, then digits, upper and lower case,
#: blanks, bytes of other letters, and the rest.
_MARKS = b".,!?'\"-:;()|#$%&*@/<>=_"
_CLASSES = len(_MARKS) + 6


def _class_table() -> np.ndarray:
    kinds = np.full(256, len(_MARKS) + 5, dtype=np.int64)
    for c in range(256):
        if c >= 128:
            kinds[c] = len(_MARKS) + 4
        elif chr(c).isdigit():
            kinds[c] = len(_MARKS)
        elif chr(c).isupper():
            kinds[c] = len(_MARKS) + 1
        elif chr(c).islower():
            kinds[c] = len(_MARKS) + 2
        elif chr(c).isspace():
            kinds[c] = len(_MARKS) + 3
    for i, c in enumerate(_MARKS):
        kinds[c] = i
    return kinds


_KIND = _class_table()
_BLANK = len(_MARKS) + 3
#: Pairs are hashed to this many columns by (first, second) class.
_PAIRS = _CLASSES * _CLASSES
WIDTH = _PAIRS + 4


def encode(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Passage rows of all word lists, and how many each has (none without words)."""
    n_words = np.array([len(w) for w in words], dtype=np.int64)
    per_doc = -(-n_words // PASSAGE_WORDS)
    n = int(per_doc.sum())
    if not n:
        return np.zeros((0, WIDTH), dtype=np.float32), per_doc
    flat = [w for ws in words for w in ws]
    first = np.cumsum(per_doc) - per_doc
    within = ranges(np.zeros(len(words), dtype=np.int64), n_words)
    passage = np.repeat(first, n_words) + within // PASSAGE_WORDS
    size = np.bincount(passage, minlength=n)
    length = np.fromiter(map(len, flat), dtype=np.int64, count=len(flat))
    ids = np.fromiter(map(hash, flat), dtype=np.int64, count=len(flat))

    kinds = np.append(_KIND[np.frombuffer(b" ".join(flat), dtype=np.uint8)], _BLANK)
    of_byte = np.repeat(passage, length + 1)
    pair = kinds[:-1] * _CLASSES + kinds[1:]
    out = np.empty((n, WIDTH), dtype=np.float32)
    counts = np.bincount(of_byte[:-1] * _PAIRS + pair, minlength=n * _PAIRS)
    counts = counts.reshape(n, _PAIRS)
    np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1), out=out[:, :_PAIRS])
    same = (ids[1:] == ids[:-1]) & (passage[1:] == passage[:-1])
    out[:, -4] = np.bincount(passage[1:], weights=same, minlength=n) / size
    order = np.lexsort((ids, passage))
    fresh = np.ones(len(ids), dtype=bool)
    fresh[1:] = (ids[order][1:] != ids[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    out[:, -3] = np.bincount(passage[order], weights=fresh, minlength=n) / size
    out[:, -2] = np.bincount(passage, weights=np.minimum(length, 40), minlength=n) / size / 10
    out[:, -1] = size / PASSAGE_WORDS
    return out, per_doc


@dataclass
class Model:
    """Layer arrays in the order of :func:`_forward`; None: a constant score."""

    layers: list[np.ndarray] | None
    constant: float = 0.5


def _forward(layers: list[np.ndarray], x: np.ndarray, starts: np.ndarray, doc: np.ndarray):
    """Document logits and what the gradient needs; every document has a passage."""
    return _attend(layers, np.tanh(x @ layers[0] + layers[1]), starts, doc)


def _attend(layers: list[np.ndarray], h: np.ndarray, starts: np.ndarray, doc: np.ndarray):
    _, _, v, u, a, c, d = layers
    tv, su = np.tanh(h @ v), sigmoid(h @ u)
    e = (tv * su) @ a
    e = np.exp(e - np.maximum.reduceat(e, starts)[doc])
    weight = e / np.add.reduceat(e, starts)[doc]
    whole = np.add.reduceat(weight[:, None] * h, starts)
    return whole @ c + d[0], h, tv, su, weight, whole


def _gradients(layers, x, starts, doc, slope, h, tv, su, weight, whole) -> list[np.ndarray]:
    _, _, v, u, a, c, _ = layers
    to_whole = slope[:, None] * c
    to_weight = (to_whole[doc] * h).sum(axis=1)
    mean = np.add.reduceat(weight * to_weight, starts)[doc]
    to_e = weight * (to_weight - mean)
    to_v = to_e[:, None] * a * su * (1 - tv * tv)
    to_u = to_e[:, None] * a * tv * su * (1 - su)
    to_h = weight[:, None] * to_whole[doc] + to_v @ v.T + to_u @ u.T
    to_z = to_h * (1 - h * h)
    return [
        x.T @ to_z, to_z.sum(axis=0), h.T @ to_v, h.T @ to_u, (tv * su).T @ to_e,
        whole.T @ slope, np.array([slope.sum()]),
    ]


def fit(sample: list[tuple[bytes, object]], epochs: int = 30, batch: int = 128,
        rate: float = 3e-3, seed: int = 7) -> Model:
    """Layers for (text, 0 or 1) rows; without both classes, a constant score."""
    sample = [(t, float(y)) for t, y in sample if t.split()]
    truth = np.array([y for _, y in sample])
    if len(set(truth)) < 2:
        return Model(None, 0.5 if not len(truth) else 0.02 + 0.96 * truth[0])
    texts = [t for t, _ in sample]
    per_doc = np.array([-(-len(t.split()) // PASSAGE_WORDS) for t in texts], dtype=np.int64)
    # shares and ratios keep what they need in half precision
    x = np.concatenate([encode(g)[0].astype(np.float16) for g in _pieces(texts)])
    ends = np.cumsum(per_doc)
    random = np.random.default_rng(seed)
    shapes = [(WIDTH, HIDDEN), (HIDDEN,), (HIDDEN, GATE), (HIDDEN, GATE), (GATE,), (HIDDEN,), (1,)]
    layers = [
        random.normal(0, 1 / np.sqrt(s[0]), s) if k not in (1, 6) else np.zeros(s)
        for k, s in enumerate(shapes)
    ]
    step = Adam(layers, rate)
    share = np.where(truth > 0, 0.5 / (truth > 0).sum(), 0.5 / (truth == 0).sum()) * len(truth)
    steps = max(epochs, -(-600 * batch // len(truth)))
    for _ in range(min(steps, 400)):
        order = random.permutation(len(truth))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            sizes = per_doc[chosen]
            rows = ranges(ends[chosen] - sizes, sizes)
            starts, doc = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(chosen)), sizes)
            part = x[rows].astype(np.float64)
            logit, *rest = _forward(layers, part, starts, doc)
            slope = (sigmoid(logit) - truth[chosen]) * share[chosen] / len(chosen)
            step([
                g + 1e-4 * v
                for g, v in zip(_gradients(layers, part, starts, doc, slope, *rest), layers, strict=True)
            ])
    return Model(layers)


def _pieces(texts: list[bytes]):
    """Lists of word lists, each list small enough to encode at once."""
    group, held = [], 0
    for text in texts:
        words = text.split()
        for at in range(0, max(len(words), 1), PIECE_WORDS):
            group.append(words[at : at + PIECE_WORDS])
            held += len(group[-1])
            if held >= PIECE_WORDS:
                yield group
                group, held = [], 0
    yield group


def scores(model: Model, texts: list[bytes]) -> np.ndarray:
    """Probability of label 1 for each text; 0 for a text without words."""
    per_doc = np.array([-(-len(t.split()) // PASSAGE_WORDS) for t in texts], dtype=np.int64)
    out = np.zeros(len(texts))
    have = np.flatnonzero(per_doc)
    if model.layers is None:
        out[have] = model.constant
    elif len(have):
        w, b = model.layers[:2]
        hidden = np.concatenate([np.tanh(encode(g)[0] @ w + b) for g in _pieces(texts)])
        sizes = per_doc[have]
        doc = np.repeat(np.arange(len(have)), sizes)
        out[have] = sigmoid(_attend(model.layers, hidden, np.cumsum(sizes) - sizes, doc)[0])
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id",
          text: str = "text") -> Model:
    """Fit on at most ``PER_CLASS`` labelled texts of each class."""
    return fit(labelled_texts(docs, labels, label, key, text, PER_CLASS, MAX_BYTES, [0, 1]))


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """A score for every row.

    Null texts and texts without words score 0.  Each row is scored on its own, so
    repeated rows repeat their result; only the columns in ``keep`` pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about 100 kB
    outputs = T.StructType([T.StructField("score", T.DoubleType())])
    return map_texts(docs, keep, text, outputs, _scorer, shared)


def accepted(docs: DataFrame, model: Model, text: str = "text", least: float = KEEP) -> DataFrame:
    """The rows, unchanged, that score ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, text, _acceptor, shared, least)


def _scorer(shared):
    return lambda texts: [scores(shared.value, [t or b"" for t in texts])]


def _acceptor(shared, least):
    return lambda texts: scores(shared.value, [t or b"" for t in texts]) >= least
