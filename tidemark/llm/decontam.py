"""Benchmark decontamination with one FM-index per shard of training text.

A shard is a few megabytes of consecutive documents.  A window can only lie where
all words are benchmark words, so the shard keeps its runs of such words that are
long enough and writes them, a separator after each, as one integer string.  Its
FM-index is the Burrows-Wheeler transform of that string in a wavelet matrix
(rank in ``log2(alphabet)`` steps) with every eighth suffix position kept.  All
windows are searched backwards together, their rows are walked to kept positions,
and the spans found are merged in word positions of the documents.

A window is ``WINDOW`` consecutive words of an item; a shorter item that has a
word is one window.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import checkpointed, cut, map_texts, prepare, ranges, tidy

WINDOW = 10
#: Every so many text positions the suffix position of a row is kept.
SAMPLE = 8
#: Pairs of words of a shard are marked in a table of so many bits.
PAIR_BITS = 23
#: Bytes of benchmark text that one pass holds; more text takes more passes.
PASS_BYTES = 16 << 20

#: Lower-cases A-Z and blanks all but digits, letters and bytes from 0x80 on.
PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)
#: Symbols below the words: end of the string, end of a run.
_END, _GAP, _FIRST = 0, 1, 2


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(PLAIN).split()


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number below ``1 << PAIR_BITS`` for each pair of neighbouring words."""
    code = a.astype(np.uint32) * np.uint32(0x9E3779B1) ^ b.astype(np.uint32) * np.uint32(0x85EBCA6B)
    return (code ^ code >> np.uint32(15)) & np.uint32((1 << PAIR_BITS) - 1)


@dataclass
class Phrases:
    """Windows to search: distinct word-number sequences and the items they are of."""

    vocabulary: dict[bytes, int]
    windows: np.ndarray  # a row for each window, zeros behind its words
    sizes: np.ndarray
    first_pair: np.ndarray
    names: list[str]
    owner_starts: np.ndarray  # where the items of each window begin in ``owners``
    owners: np.ndarray  # places in ``names``

    def shortest(self) -> int:
        return int(self.sizes.min(initial=1 << 30)) if len(self.sizes) else 0

    def items(self, window: int) -> list[str]:
        return [self.names[k] for k in self.owners[self.owner_starts[window] : self.owner_starts[window + 1]]]

    def possible(self, text: np.ndarray) -> np.ndarray:
        """The windows whose words all stand in a shard's text, pair by pair."""
        present = np.zeros(_FIRST + len(self.vocabulary), dtype=bool)
        present[text] = True
        pairs = np.zeros(1 << PAIR_BITS, dtype=bool)
        both = (text[:-1] >= _FIRST) & (text[1:] >= _FIRST)
        pairs[_pair(text[:-1][both], text[1:][both])] = True
        live = np.flatnonzero((pairs[self.first_pair] | (self.sizes == 1)) & present[self.windows[:, 0]])
        for k in range(1, self.windows.shape[1] - 1):
            left, right = self.windows[live, k], self.windows[live, k + 1]
            live = live[(right == 0) | pairs[_pair(left, right)]]
            if not len(live):
                break
        return live


def phrases(rows: list[tuple[object, bytes | None]], window: int = WINDOW) -> Phrases:
    """Windows of (item id, text) rows.

    Rows of one item id count as one item.  A window of a row without an id still
    hits, but no item is named for it.
    """
    vocabulary: dict[bytes, int] = {}
    names = sorted({str(item) for item, _ in rows if item is not None})
    place = {name: k for k, name in enumerate(names)}
    flat, lengths, owner = [], [], []
    for item, text in rows:
        if own := words(text):
            flat += [vocabulary.setdefault(w, _FIRST + len(vocabulary)) for w in own]
            lengths.append(len(own))
            owner.append(place[str(item)] if item is not None else -1)
    lengths, owner = np.array(lengths, dtype=np.int64), np.array(owner, dtype=np.int64)
    padded = np.array([*flat, *[0] * window], dtype=np.int32)
    sizes = np.minimum(lengths, window)
    counts = lengths - sizes + 1
    starts = ranges(np.cumsum(lengths) - lengths, counts)
    matrix = padded[starts[:, None] + np.arange(window)]
    matrix[np.arange(window) >= np.repeat(sizes, counts)[:, None]] = 0
    matrix, number = np.unique(matrix, axis=0, return_inverse=True)
    owned = np.stack([number.ravel(), np.repeat(owner, counts)], axis=1)
    owned = np.unique(owned[owned[:, 1] >= 0], axis=0)
    return Phrases(
        vocabulary, matrix, (matrix > 0).sum(axis=1), _pair(matrix[:, 0], matrix[:, min(1, window - 1)]), names,
        np.searchsorted(owned[:, 0], np.arange(len(matrix) + 1)), owned[:, 1],
    )


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix positions in order, by prefix doubling; the last symbol must be unique."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, step = len(text), 1
    while True:
        following = np.zeros(n, dtype=np.int64)
        following[: n - step] = rank[step:] + 1
        key = rank * (n + 2) + following
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Full-text index of an integer string that ends in its only, smallest 0."""

    def __init__(self, text: np.ndarray, alphabet: int) -> None:
        order = suffix_array(text)
        last = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])
        kept = (order % SAMPLE == 0) | (order == 0)
        self.kept_rank = np.concatenate([[0], np.cumsum(kept)])
        self.kept, self.positions = kept, order[kept]
        self.last = last
        self.levels = []
        symbols = last
        for bit in reversed(range(max(int(alphabet - 1).bit_length(), 1))):
            ones = (symbols >> bit) & 1
            self.levels.append((bit, np.concatenate([[0], np.cumsum(ones)]), int((ones == 0).sum())))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])
        # where each symbol's block starts on the lowest level
        self.block = self._descend(np.arange(alphabet), np.zeros(alphabet, dtype=np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, ones, zeros in self.levels:
            up = ones[at]
            at = np.where((symbols >> bit) & 1 == 1, zeros + up, at - up)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands among the first ``at`` of the transform."""
        return self._descend(symbols, at) - self.block[symbols]

    def search(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last row (exclusive) of the suffixes that start with each pattern."""
        low = np.zeros(len(patterns), dtype=np.int64)
        high = np.full(len(patterns), len(self.last), dtype=np.int64)
        live = np.arange(len(patterns))
        for step in range(patterns.shape[1]):
            live = live[(sizes[live] > step) & (low[live] < high[live])]
            if not len(live):
                break
            symbol = patterns[live, sizes[live] - 1 - step]
            low[live] = self.before[symbol] + self.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.rank(symbol, high[live])
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row's suffix."""
        rows, walked = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        live = np.flatnonzero(~self.kept[rows])
        while len(live):
            symbol = self.last[rows[live]]
            rows[live] = self.before[symbol] + self.rank(symbol, rows[live])
            walked[live] += 1
            live = live[~self.kept[rows[live]]]
        return self.positions[self.kept_rank[rows]] + walked


def find(known: Phrases, texts: list[bytes | None]) -> list[tuple[int, np.ndarray, list[str]]]:
    """For each text: words, merged hit spans as (first, past last) rows, items found."""
    split = [words(t) for t in texts]
    sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    starts = np.cumsum(sizes) - sizes
    blank = np.zeros((0, 2), dtype=np.int64)
    out = [(int(n), blank, []) for n in sizes]
    least = known.shortest()
    if not least or not sizes.sum():
        return out
    get = known.vocabulary.get
    ids = np.fromiter((get(w, 0) for ws in split for w in ws), dtype=np.int64, count=int(sizes.sum()))
    # runs of benchmark words inside one document
    inside = np.concatenate([[0], (ids > 0).view(np.int8), [0]])
    step = np.diff(inside)
    first, past = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cuts = starts[(sizes > 0) & (starts > 0)]
    cuts = cuts[(ids[cuts] > 0) & (ids[cuts - 1] > 0)]
    first, past = np.sort(np.append(first, cuts)), np.sort(np.append(past, cuts))
    long = past - first >= least
    first, length = first[long], (past - first)[long]
    if not len(first):
        return out
    # each run, its separator, and at last the end of the string
    size = length + 1
    at = np.cumsum(size) - size
    text = np.full(int(size.sum()) + 1, _GAP, dtype=np.int64)
    origin = np.full(len(text), -1, dtype=np.int64)
    places, sources = ranges(at, length), ranges(first, length)
    text[places], origin[places], text[-1] = ids[sources], sources, _END
    asked = known.possible(text)
    if not len(asked):
        return out
    index = FMIndex(text, _FIRST + len(known.vocabulary))
    low, high = index.search(known.windows[asked], known.sizes[asked])
    count = high - low
    hits = np.flatnonzero(count)
    if not len(hits):
        return out
    begin = origin[index.locate(ranges(low[hits], count[hits]))]
    which = np.repeat(asked[hits], count[hits])
    width = known.sizes[which]
    delta = np.bincount(begin, minlength=len(ids) + 1) - np.bincount(
        begin + width, minlength=len(ids) + 1
    )
    hit = np.cumsum(delta)[:-1] > 0
    doc = np.searchsorted(starts + sizes, begin, side="right")
    named = defaultdict(set)
    for d, w in set(zip(doc.tolist(), which.tolist(), strict=True)):
        named[d].update(known.items(w))
    for d in np.unique(doc):
        own = np.concatenate([[0], hit[starts[d] : starts[d] + sizes[d]].view(np.int8), [0]])
        edge = np.diff(own)
        spans = np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)
        out[d] = (int(sizes[d]), spans, sorted(named[d]))
    return out


def merged(spans: Column) -> Column:
    """Overlapping or touching spans as one."""
    def add(done: Column, span: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.array(F.array(last[0], F.greatest(last[1], span[1])))
        return F.when(
            span[0] <= last[1], F.concat(F.slice(done, F.lit(1), F.size(done) - 1), longer)
        ).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(spans), F.array().cast(_SPANS), add)


_SPANS = T.ArrayType(T.ArrayType(T.LongType()))
_OUTPUTS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", _SPANS),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def _dealt(benchmark: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """Distinct rows of the benchmark, and how many passes their text takes."""
    rows = benchmark.select(
        F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text")
    ).where(F.col("text").isNotNull()).distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return rows, 1 + 2 * total // PASS_BYTES if total > PASS_BYTES else 1


def passes(benchmark: DataFrame, key: str, text: str) -> Iterator[list[tuple[object, bytes]]]:
    """The benchmark in lists of at most ``PASS_BYTES`` of text, one in memory at a time."""
    rows, n = _dealt(benchmark, key, text)
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("key", "text"), F.lit(n)) == k) if n > 1 else rows
        yield sorted(((r.key, r.text.encode()) for r in part.collect()), key=repr)


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text",
                  item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``n_words``, merged ``spans`` of hit words and sorted ``items`` of every row.

    A null or empty text has no words.  Rows are searched on their own.  A benchmark
    over ``PASS_BYTES`` is searched in several passes, whose spans are merged.
    """
    context = docs.sparkSession.sparkContext
    found = None
    for rows in passes(benchmark, item_key, item_text):
        shared = context.broadcast(phrases(rows))  # PASS_BYTES of text at most
        if found is None:
            names = [f"c{i}" for i in range(len(keep))]
            source = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)),
                                 F.col(text).cast("string").alias("text"))
            found = map_texts(source, [*names, "text"], "text", _OUTPUTS, _finder, shared)
            continue
        more = map_texts(checkpointed(found), [*names, "text", "spans", "items"], "text",
                         T.StructType([_OUTPUTS[0], T.StructField("spans2", _SPANS),
                                       T.StructField("items2", T.ArrayType(T.StringType()))]),
                         _finder, shared)
        found = more.select(
            *names, "text", "n_words",
            merged(F.concat("spans", "spans2")).alias("spans"),
            F.array_sort(F.array_distinct(F.concat("items", "items2"))).alias("items"),
        )
    return found.select(
        *(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), "n_words", "spans", "items"
    )


def _finder(shared):
    def work(texts):
        found = find(shared.value, texts)
        return [[n for n, _, _ in found], [s.tolist() for _, s, _ in found], [i for _, _, i in found]]

    return work


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def without_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text",
                  length: str | None = None, item_key: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """The rows, all columns as they were, with the hit words cut from their text.

    From the first byte of a span's first word to the last of its last word goes.
    Should what is left then read as a window, that is cut as well.  Where a text
    changed, the column ``length`` (if given) gets its new number of characters.
    Rows without a hit, and rows left without words, stay.

    A benchmark over ``PASS_BYTES`` is searched in several passes.  The spans of all of
    them are cut from one text at once, as in a single pass, and the rows that had some
    are searched again by all passes until none has any.
    """
    context = docs.sparkSession.sparkContext
    prepare(docs.sparkSession)
    schema = docs.schema
    names = schema.fieldNames()
    at, size_at = names.index(text), names.index(length) if length else None
    arrow = to_arrow_schema(schema)
    if _dealt(benchmark, item_key, item_text)[1] == 1:
        shared = context.broadcast(phrases(next(passes(benchmark, item_key, item_text))))
        return docs.mapInArrow(_cutter(_cleaner(shared), arrow, at, size_at), schema)
    plain = [f"p{i}" for i in range(len(names))]
    done, left = None, docs
    while True:
        found = checkpointed(contamination(left.toDF(*plain), benchmark, plain, plain[at],
                                           item_key, item_text).select(*plain, "spans"))
        hit = F.size("spans") > 0
        clear = found.where(~hit).select(*plain).toDF(*names)
        done = clear if done is None else done.union(clear)
        if found.where(hit).isEmpty():
            return done
        left = checkpointed(
            found.where(hit).mapInArrow(_cutter(_remover, arrow, at, size_at), schema)
        )


def _cleaner(shared):
    return lambda part, texts: clean(shared.value, texts)


def _remover(part: pa.RecordBatch, texts: list[bytes | None]) -> dict[int, bytes]:
    """The texts without the spans of the last column."""
    spans = part.column(part.num_columns - 1).to_pylist()
    return {k: remove(t, s) for k, (t, s) in enumerate(zip(texts, spans, strict=True)) if s}


def _cutter(change, arrow: pa.Schema, at: int, size_at: int | None):
    """Batches as ``arrow`` says, with the texts that ``change`` gives by place."""

    def run(batches):
        for batch in batches:
            for part in cut(batch, at):
                texts = part.column(at).cast(pa.binary()).to_pylist()
                new = change(part, texts)
                columns = [part.column(i).cast(f.type) for i, f in enumerate(arrow)]
                if new:
                    made = [new.get(k, t) for k, t in enumerate(texts)]
                    columns[at] = pa.array(made, pa.binary()).cast(arrow.field(at).type)
                    if size_at is not None:
                        sizes = columns[size_at].to_pylist()
                        for k, t in new.items():
                            sizes[k] = len(t.decode("utf-8", "replace"))
                        columns[size_at] = pa.array(sizes, arrow.field(size_at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return tidy(run)


def clean(known: Phrases, texts: list[bytes | None]) -> dict[int, bytes]:
    """The texts that had windows, by place, without them."""
    new: dict[int, bytes] = {}
    rows, now = list(range(len(texts))), texts
    while rows:
        found = find(known, now)
        hit = [(k, t, s.tolist()) for k, t, (_, s, _) in zip(rows, now, found, strict=True) if len(s)]
        rows, now = [k for k, _, _ in hit], [remove(t, s) for _, t, s in hit]
        new.update(zip(rows, now, strict=True))
    return new


def remove(text: bytes, spans: list[list[int]]) -> bytes:
    """The text without the words of the spans; blanks between spans' ends stay."""
    plain, out, at, k = text.translate(PLAIN), [], 0, 0
    ends, place = [], 0
    for w in plain.split():
        place = plain.index(w, place)
        ends.append((place, place + len(w)))
        place += len(w)
    for a, b in spans:
        out.append(text[at : ends[a][0]])
        at = ends[b - 1][1]
    return b"".join([*out, text[at:]])
