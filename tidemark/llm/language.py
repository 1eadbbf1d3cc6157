"""Language identification by averaged hashed subword embeddings.

A text is lower-cased (A-Z), everything but letters becomes one blank, and its
subwords are all byte 3-grams and 4-grams, blanks at word ends included.  Each
is hashed to a row of an embedding table; the mean of the rows goes through a
linear softmax.  Embeddings and softmax are trained together by stochastic
gradient descent in numpy on a bounded sample.  A temperature is then calibrated
on sample rows held back from the descent.

A softmax only tells the learned languages from each other.  So a text is rejected
for either of two measures: its calibrated probability, and how familiar it is, the
mean log-probability of its subwords in the training texts, all languages alike.
Held-back rows give the least value of both for each class of length: whole texts,
and for the short classes pieces of them as well.

The classifier is linear in the subwords, so tasks use the product of both
tables: one row of logits for each bucket.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import keep_rows, labelled_texts, map_texts

#: Texts of each language that the fit may hold, and bytes of one of them.
PER_CLASS, MAX_BYTES = 1200, 20_000
#: Texts of all languages together; with more languages each has fewer.
MAX_TEXTS = 6000
BUCKETS, DIMENSIONS = 1 << 16, 12
#: Rounds over the sample and first step size, for few and for many languages.
STEPS = (4, 2.0), (20, 8.0)
#: Bytes of text hashed at once.
PIECE_BYTES = 1 << 20
#: Languages in the sample, the most frequent ones: as many as it has texts.
MAX_LANGUAGES = MAX_TEXTS
#: Share of texts of known language that may be rejected, half by either measure.
REJECTED = 0.001
#: Subwords from which the next class of length begins; held-back pieces of texts
#: count in the first ``PIECE_CLASSES`` classes only.
LENGTHS, PIECE_CLASSES = (64, 256, 2048), 2
#: With fewer held-back rows a class takes the least values of all that it may count.
LEAST_HELD = 100
#: Share of its probability that each language leaves to subwords it has not shown.
UNSEEN = 0.01
UNKNOWN = "und"

_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)
)
_ASCII = re.compile(rb"[A-Za-z]")


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS + 1 rows, the last all zero: logits, or embeddings to be mixed
    mix: np.ndarray | None  # logits of embeddings, if there are more languages than dimensions
    bias: np.ndarray
    temperature: float
    seen: np.ndarray  # log-probability of each bucket in the training texts, the last 0
    floors: np.ndarray  # for each class of length: least log-odds and least familiarity


def has_letter(text: bytes) -> bool:
    if _ASCII.search(text):
        return True
    return not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace")))


def subwords(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each subword of all texts in turn, and each text's place in it.

    Windows that leave their text get the bucket ``BUCKETS``.
    """
    plain = [b" " + b" ".join(t.translate(_LETTERS).split()) + b" " for t in texts]
    sizes = np.fromiter(map(len, plain), dtype=np.int64, count=len(plain))
    data = np.frombuffer(b"".join(plain), dtype=np.uint8).astype(np.uint32)
    ends = np.cumsum(sizes)
    out = np.full((len(data), 2), BUCKETS, dtype=np.int32)
    for column, n in enumerate((3, 4)):
        if len(data) < n:
            continue
        code = data[: len(data) - n + 1].copy()
        for k in range(1, n):
            code = code * np.uint32(0x01000193) + data[k : len(data) - n + 1 + k]
        code = (code * np.uint32(0x9E3779B1) + np.uint32(n)) * np.uint32(0x85EBCA6B)
        out[: len(code), column] = (code >> np.uint32(16)).astype(np.int32) & (BUCKETS - 1)
        for k in range(1, n):
            last = ends - k
            out[last[sizes >= k], column] = BUCKETS
    return out, ends - sizes


def _bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = subwords([text])[0].ravel()
    ids, counts = np.unique(ids[ids < BUCKETS], return_counts=True)
    return ids, (counts / max(counts.sum(), 1)).astype(np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-12, 1 - 1e-12)
    return np.log(p) - np.log1p(-p)


def floor_of(values: np.ndarray, share: float) -> float:
    """The value that a ``share`` of the population is below.

    With too few values to read it off, the tail below the median is taken as
    exponential and carried on from the lowest value.
    """
    if len(values) * share >= 1:
        return float(np.quantile(values, share))
    middle, lowest = np.median(values), values.min()
    if len(values) < 4:
        return -np.inf
    return float(middle - (middle - lowest) * np.log(0.5 / share) / np.log(0.5 * len(values)))


def _floors(odds: np.ndarray, familiar: np.ndarray, n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Least log-odds and least familiarity of each class of length."""
    of = np.searchsorted(LENGTHS, n, side="right")
    out = np.full((len(LENGTHS) + 1, 2), -np.inf)
    for k in range(len(out)):
        usable = whole | (k < PIECE_CLASSES)
        own = usable & (of == k)
        own = own if own.sum() >= LEAST_HELD else usable
        for column, values in enumerate((odds, familiar)):
            out[k, column] = floor_of(values[own], REJECTED / 2) if own.any() else -np.inf
    return out


def fit(sample: list[tuple[bytes, object]], seed: int = 11) -> Model:
    """Train on (text, language) rows; every fifth row is kept for calibration.

    Each training text is also seen as a short piece of itself, as short texts
    have to be told apart as well.
    """
    random = np.random.default_rng(seed)
    sample = [(t, str(y)) for t, y in sample if has_letter(t)]
    languages = sorted({y for _, y in sample})
    number = {y: i for i, y in enumerate(languages)}
    epochs, rate = STEPS[len(languages) > DIMENSIONS]
    embed = random.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS
    weight = np.zeros((DIMENSIONS, len(languages)))
    bias = np.zeros(len(languages))
    bags, held, sizes, whole = [], [], [], []
    shown: list[list[int]] = [[] for _ in languages]
    for k, at in enumerate(random.permutation(len(sample))):
        text, y = sample[at]
        words = text.split()
        begin = int(random.integers(0, max(len(words) - 8, 1)))
        piece = b" ".join(words[begin : begin + int(random.integers(2, 12))])
        for t in (text, piece):
            if not has_letter(t):
                continue
            ids, share = _bag(t)
            if k % 5 != 4:
                bags.append((ids, share, number[y]))
                if t is text:
                    shown[number[y]].append(len(bags) - 1)
            elif len(ids):
                held.append((ids, share, number[y]))
                sizes.append(int((subwords([t])[0] < BUCKETS).sum()))
                whole.append(t is text)
    total = max(epochs * len(bags), 1)
    done = 0
    for _ in range(epochs):
        for at in random.permutation(len(bags)):
            ids, share, y = bags[at]
            lr = rate * (1 - done / total)
            done += 1
            mean = share @ embed[ids]
            slope = _softmax(mean @ weight + bias)
            slope[y] -= 1
            back = weight @ slope
            weight -= 0.1 * lr * np.outer(mean, slope)
            bias -= 0.01 * lr * slope
            embed[ids] -= lr * share[:, None] * back
    mix = weight if len(languages) > DIMENSIONS else None
    table = np.zeros((BUCKETS + 1, min(len(languages), DIMENSIONS)), dtype=np.float32)
    table[:-1] = embed if mix is not None else embed @ weight
    mean_share = np.zeros(BUCKETS)
    for of_language in shown:
        share_of = np.zeros(BUCKETS)
        for k in of_language:
            share_of[bags[k][0]] += bags[k][1]
        mean_share += (1 - UNSEEN) * share_of / max(share_of.sum(), 1e-12) + UNSEEN / BUCKETS
    seen = np.zeros(BUCKETS + 1)
    seen[:-1] = np.log(mean_share / len(languages)) if languages else 0
    temperature, floors = 1.0, np.full((len(LENGTHS) + 1, 2), -np.inf)
    if held:
        logits = np.array([share @ table[ids] for ids, share, _ in held])
        logits = (logits if mix is None else logits @ mix) + bias
        truth = np.array([y for _, _, y in held])
        rows = np.arange(len(truth))

        def loss(t: float) -> float:
            return float(-np.log(_softmax(logits / t)[rows, truth] + 1e-12).mean())

        temperature = min((2.0**k for k in np.arange(-3, 4, 0.25)), key=loss)
        odds = _log_odds(_softmax(logits / temperature).max(axis=1))
        familiar = np.array([share @ seen[ids] for ids, share, _ in held])
        floors = _floors(odds, familiar, np.array(sizes), np.array(whole))
    return Model(languages, table, mix, bias, float(temperature), seen, floors)


def _pieces(texts: list[bytes | None]):
    """Places of texts and pieces of them, some ``PIECE_BYTES`` together; cut at blanks."""
    owners, pieces, held = [], [], 0
    for k, text in enumerate(texts):
        text, at = text or b"", 0
        while at < len(text) or not at:
            stop = min(at + PIECE_BYTES, len(text))
            if stop < len(text):
                blank = text.rfind(b" ", at + 1, stop)
                stop = blank if blank > 0 else stop
            owners.append(k)
            pieces.append(text[at:stop])
            held, at = held + stop - at, max(stop, 1)
            if held >= PIECE_BYTES:
                yield np.array(owners), pieces
                owners, pieces, held = [], [], 0
    if owners:
        yield np.array(owners), pieces


def predict(model: Model, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, calibrated probability and rejection of each text."""
    known = [bool(t) and has_letter(t) for t in texts]
    if not model.languages or not texts:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
    n, familiar = np.zeros(len(texts)), np.zeros(len(texts))
    sums = np.zeros((len(texts), model.table.shape[1]))
    for owners, pieces in _pieces(texts):
        ids, starts = subwords(pieces)
        np.add.at(n, owners, np.add.reduceat((ids < BUCKETS).sum(axis=1), starts))
        for c in range(sums.shape[1]):
            column = np.ascontiguousarray(model.table[:, c])
            part = np.add.reduceat(column[ids].sum(axis=1), starts, dtype=np.float64)
            np.add.at(sums[:, c], owners, part)
        np.add.at(familiar, owners, np.add.reduceat(model.seen[ids].sum(axis=1), starts))
    means = sums / np.maximum(n, 1)[:, None]
    logits = (means if model.mix is None else means @ model.mix) + model.bias
    p = _softmax(logits / model.temperature)
    best = p.argmax(axis=1)
    score = np.where(known, p[np.arange(len(texts)), best], 0.0)
    names = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
    least = model.floors[np.searchsorted(LENGTHS, n, side="right")]
    low = (_log_odds(score) < least[:, 0]) | (familiar / np.maximum(n, 1) < least[:, 1])
    return names, score, ~np.array(known) | low


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on at most ``PER_CLASS`` texts of each language, ``MAX_TEXTS`` of all together.

    Should there be more languages than that, the sample holds the most frequent ones.
    """
    frequent = (
        docs.where(F.col(lang).isNotNull()).groupBy(lang).count()
        .orderBy(F.desc("count"), lang).limit(MAX_LANGUAGES)
    )
    names = sorted(r[0] for r in frequent.select(lang).collect())  # at most MAX_LANGUAGES
    labels = docs.select(key, lang)
    each = max(min(PER_CLASS, MAX_TEXTS // max(len(names), 1)), 1)
    return fit(labelled_texts(docs, labels, lang, key, text, each, MAX_BYTES, names))


def identify(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``lang_pred``, ``score`` and ``rejected`` for every row.

    Null texts and texts without a letter are ``und``, score 0 and are rejected;
    so are texts that are less likely or less familiar than known ones of their length.
    Each row is judged on its own; only the columns in ``keep`` pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats
    outputs = T.StructType(
        [
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("rejected", T.BooleanType()),
        ]
    )
    return map_texts(docs, keep, text, outputs, _identifier, shared)


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows, unchanged, that are not rejected."""
    return keep_rows(docs, text, _acceptor, docs.sparkSession.sparkContext.broadcast(model))


def _identifier(shared):
    return lambda texts: list(predict(shared.value, texts))


def _acceptor(shared):
    return lambda texts: ~predict(shared.value, texts)[2]
