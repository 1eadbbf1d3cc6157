"""Token counts without token ids.

The tokenizer drops white space and no piece crosses its pre-tokens, so a text is a bag
of those.  Within a task every distinct pre-token is tokenized once, by the library's own
normalizer, pre-tokenizer and model, and only its number of pieces is kept.  Texts become
(document, pre-token, frequency) rows, which are joined to those numbers and summed.
Nothing is shuffled.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidemark.llm.common import map_texts, ranges

#: Distinct pre-tokens that a task remembers, and bytes of text split at once.
CACHE, SLICE_BYTES = 300_000, 1 << 20

#: Fixed values of the public word-level tokenizer: its split rule ...
WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
#: ... and what it comes to for printable ASCII, composed Latin-1 letters and ASCII blanks.
#: Any other piece between blanks goes through the library's normalizer and pre-tokenizer.
_ODD = re.compile("[^\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]")
_WORDS = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[!-/:-`{-~]+"
)
_BLANK = re.compile(rb"[\t-\r ]")
#: Marks the names of pre-tokens that the library split off, and of pieces with special tokens.
_LIBRARY, _SPECIAL = "\n", "\n\n"


_BLANKS = {c: " " for c in (9, 10, 11, 12, 13)}


def _rules(part) -> dict:
    """What a normalizer or pre-tokenizer does; nothing for none."""
    return json.loads(part.__getstate__()) if part is not None else {}


class _Numbers(dict):
    """A number for each name, in the order of their first use; ``fresh`` lists the latest."""

    def __init__(self, names=()) -> None:
        super().__init__(zip(names, range(len(names)), strict=True))
        self.fresh = []

    def __missing__(self, name: str) -> int:
        self[name] = number = len(self)
        self.fresh.append(name)
        return number


class Pretokens:
    """Numbers for pre-tokens, and how many pieces (or which) each has."""

    def __init__(self, path: str, with_ids: bool) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        encode = self.tokenizer.encode
        both = encode("a b", add_special_tokens=False).ids
        apart = [encode(x, add_special_tokens=False).ids for x in "ab"]
        if both != apart[0] + apart[1] or self.tokenizer.truncation or self.tokenizer.padding:
            raise ValueError(f"{path}: pieces may cross white space, or texts are cut or padded")
        # the parts only: the whole tokenizer as text would take its vocabulary along
        rules = _rules(self.tokenizer.pre_tokenizer).get("pretokenizers", [{}])
        changes = _rules(self.tokenizer.normalizer).get("normalizers", [])
        self.plain_words = (
            rules[0].get("pattern") == {"Regex": WORD_RULE}
            and [r.get("type") for r in rules[1:]] == ["ByteLevel"]
            and [c["type"] for c in changes] == WORD_NORMALIZERS
        )
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.byte_level = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}
        self.hidden = frozenset(map(chr, hidden))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.with_ids, self.model = with_ids, self.tokenizer.model
        self._clear()

    def _clear(self) -> None:
        self.known, self.uses = _Numbers(), np.zeros(0, dtype=np.int64)
        self.counts, self.ids = array("q"), array("I")

    def _forget(self) -> None:
        """Drop what was used once only, or of more than half a cache all but the most used."""
        kept = np.flatnonzero(self.uses > 1)
        if len(kept) > CACHE // 2:
            kept = np.sort(kept[np.argsort(-self.uses[kept], kind="stable")[: CACHE // 2]])
        sizes, names = self.sizes(), list(self.known)
        self.known = _Numbers([names[i] for i in kept])
        # what stays has to be used again to stay the next time
        self.uses = np.zeros(len(kept), dtype=np.int64)
        self.counts = array("q", sizes[kept].tobytes())
        if self.with_ids:
            starts = np.cumsum(sizes) - sizes
            ids = np.array(self.ids, dtype=np.uint32)[ranges(starts[kept], sizes[kept])]
            self.ids = array("I", ids.tobytes())

    def split(self, text: bytes) -> list[str]:
        """Names of the pre-tokens of a text, in order."""
        text = text.decode("utf-8", "replace")
        if any(s in text for s in self.special) or not self.plain_words or _ODD.search(text):
            return [name for piece in text.split(" ") for name in self._split_piece(piece)]
        return _WORDS.findall(text.lower())

    def _split_piece(self, piece: str) -> list[str]:
        """The same for a part of a text between two blanks."""
        special = any(s in piece for s in self.special)
        if not special and self.plain_words and not _ODD.search(piece):
            return _WORDS.findall(piece.lower())
        if len(parts := piece.translate(_BLANKS).split(" ")) > 1:
            return [name for part in parts for name in self._split_piece(part)]
        if special:
            return [_SPECIAL + piece]
        tokenizer = self.tokenizer
        text = tokenizer.normalizer.normalize_str(piece) if tokenizer.normalizer else piece
        return [_LIBRARY + w for w, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)] if text else []

    def _pieces(self, name: str) -> list[int]:
        """Ids of a pre-token."""
        if not name.startswith(_LIBRARY):
            word = name
            if not name.isascii():
                word = name.encode().decode("latin-1")
                if not self.hidden.isdisjoint(word):
                    word = word.translate(self.byte_level)
        elif name.startswith(_SPECIAL):
            return self.tokenizer.encode(name[len(_SPECIAL) :], add_special_tokens=False).ids
        else:
            word = name[len(_LIBRARY) :]
        return [t.id for t in self.model.tokenize(word)]

    def _add(self, names: list[str]) -> None:
        pieces, counts, ids = self._pieces, self.counts, self.ids
        for name in names:
            found = pieces(name)
            counts.append(len(found))
            if self.with_ids:
                ids.extend(found)

    def numbers(self, names: list[str]) -> np.ndarray:
        """The number of each pre-token; valid until the next call."""
        if len(self.known) > CACHE:
            self._forget()
        known = self.known
        found = np.fromiter(map(known.__getitem__, names), dtype=np.int64, count=len(names))
        self._add(known.fresh)
        known.fresh = []
        uses = np.bincount(found, minlength=len(known))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        return found

    def sizes(self) -> np.ndarray:
        return np.array(self.counts, dtype=np.int64)

    def slices(self, texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text, number) of all pre-tokens, some ``SLICE_BYTES`` of text at a time.

        Long texts are cut at blanks; numbers are valid until the next slice.
        """
        owners, sizes, names, held = [], [], [], 0
        for k, text in enumerate(texts):
            text, at = text or b"", 0
            while at < len(text):
                stop = min(at + SLICE_BYTES, len(text))
                if stop < len(text):
                    blank = _BLANK.search(text, stop)
                    stop = blank.start() if blank else len(text)
                found = self.split(text[at:stop])
                owners.append(k)
                sizes.append(len(found))
                names += found
                held, at = held + stop - at, stop
                if held >= SLICE_BYTES:
                    yield np.repeat(owners, sizes), self.numbers(names)
                    owners, sizes, names, held = [], [], [], 0
        if owners:
            yield np.repeat(owners, sizes), self.numbers(names)

    def encoded(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and how many each has."""
        parts, counts = [np.zeros(0, dtype=np.uint32)], np.zeros(len(texts))
        for owner, numbers in self.slices(texts):
            sizes = self.sizes()
            starts = np.cumsum(sizes) - sizes
            per_word = sizes[numbers]
            parts.append(np.array(self.ids, dtype=np.uint32)[ranges(starts[numbers], per_word)])
            counts += np.bincount(owner, per_word, minlength=len(texts))
        return np.concatenate(parts), counts.astype(np.int64)


_loaded: dict[tuple[str, bool], Pretokens] = {}


def pretokens(path: str, with_ids: bool = False) -> Pretokens:
    """This process's table for a tokenizer file; later tasks find it filled."""
    if (path, with_ids) not in _loaded:
        _loaded[path, with_ids] = Pretokens(path, with_ids)
    return _loaded[path, with_ids]


def counts(table: Pretokens, texts: list[bytes | None]) -> list[np.ndarray]:
    """Bytes and pieces of each text."""
    per_doc = np.zeros(len(texts))
    for owner, numbers in table.slices(texts):
        pieces = table.sizes()
        width = max(len(pieces), 1)
        pairs, frequency = np.unique(owner * width + numbers, return_counts=True)
        per_doc += np.bincount(pairs // width, frequency * pieces[pairs % width], minlength=len(texts))
    n_bytes = np.array([len(t or b"") for t in texts], dtype=np.int64)
    return [n_bytes, per_doc.astype(np.int64)]


def count_tokens(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``n_bytes`` and ``n_tokens`` of every row's whole text under a tokenizer file.

    ``path`` must exist on the executors.  A null text counts as empty: 0 bytes,
    0 tokens.  Rows are counted on their own, so repeated rows repeat their counts;
    only the columns in ``keep`` pass through.
    """
    outputs = T.StructType(
        [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    )
    return map_texts(docs, keep, text, outputs, _counter, path)


def _counter(path: str):
    table = pretokens(path)
    return lambda texts: counts(table, texts)
