"""SentencePiece encoding and decoding by an Aho-Corasick Viterbi pass.

An Aho-Corasick automaton over the pieces reads a text once.  At each character
its output links name every piece that ends there, longest first; each relaxes
the best score at that place by the best score where it starts.  The best path is
read off backwards.  A character that no piece ends on costs ``UNKNOWN_COST`` more
than the worst piece and becomes byte pieces.

No piece has a blank, line feed or mark after a letter or digit, so the best path
of a text is the best paths of its words in turn (blanks, then marks, then the
rest), and a task finds the path of each distinct word once.

A unigram model file brings log probabilities as scores.  The scores of a BPE
model file are merge ranks; rank *r* gets Zipf's ``-log(r + 2)``, in steps of
1/64 so that sums of scores, and ties between them, are exact.
"""

from __future__ import annotations

import re
import zlib
from array import array

import ahocorasick
import numpy as np
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

from tidemark.llm.common import kept, map_texts, ranges

UNKNOWN_COST = 10.0
#: Distinct words that a task remembers.
CACHE = 150_000
#: Fixed values of the model file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
UNIGRAM, SPACE = 1, "▁"



def zipf_scores(model: sentencepiece_model_pb2.ModelProto) -> None:
    """Turn a model of merge ranks into one of unigram scores, in place."""
    for piece in model.pieces:
        if piece.type == NORMAL:
            piece.score = -round(64 * float(np.log(2.0 - piece.score))) / 64
    model.trainer_spec.model_type = UNIGRAM


def load_model(path: str) -> sentencepiece_model_pb2.ModelProto:
    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    if model.trainer_spec.model_type != UNIGRAM:
        zipf_scores(model)
    return model


def _word_rule(pieces: list[str]) -> re.Pattern:
    """Cuts a text where no piece can cross: before blanks, line feeds, and marks that
    follow a letter or digit (but for the few that some piece has before a mark)."""
    odd = {
        a for p in pieces for a, b in zip(p, p[1:]) if a.isalnum() and not b.isalnum() and b != SPACE
    }
    odd = re.escape("".join(sorted(odd | {"_"})))
    mark, letter = f"(?:[^ \n\\w]|[{odd}])", f"[^\\W{odd}]"
    return re.compile(f"(?: +|\n+){mark}*{letter}*|{mark}+{letter}*|{letter}+")


class Encoder:
    """The automaton of a model file, and the words it has encoded so far."""

    def __init__(self, path: str) -> None:
        model = load_model(path)
        normal = [(i, p) for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER_DEFINED)]
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        rules = model.normalizer_spec
        crossing = [p.piece for _, p in normal if SPACE in p.piece.lstrip(SPACE) or "\n" in p.piece]
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or crossing:
            raise ValueError(f"{path}: normalizes texts, or has pieces across words")
        if len(self.bytes) != 256 or any(p.type == USER_DEFINED for _, p in normal):
            raise ValueError(f"{path}: needs byte pieces and no pieces defined by a user")
        self.word = _word_rule([p.piece for _, p in normal])
        self.prefix = " " if rules.add_dummy_prefix else ""
        self.automaton = ahocorasick.Automaton()
        for i, p in normal:
            self.automaton.add_word(p.piece, (len(p.piece), p.score, i))
        self.automaton.make_automaton()
        self.unknown = min(p.score for _, p in normal) - UNKNOWN_COST
        surfaces: list[bytes] = []
        for p in model.pieces:
            if p.type == BYTE:
                surfaces.append(bytes([int(p.piece[1:-1], 16)]))
            elif p.type == CONTROL:
                surfaces.append(b"")
            elif p.type == UNKNOWN:
                surfaces.append(model.trainer_spec.unk_surface.encode())
            else:
                surfaces.append(p.piece.replace(SPACE, " ").encode())
        self.surfaces = surfaces
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.counts, self.flat = array("q"), array("I")

    def _unknown(self, best: list, origin: list, at: int) -> None:
        """Relax place ``at`` by a character that is no piece by itself."""
        total = best[at - 1] + self.unknown
        if best[at] is None or total > best[at]:
            best[at], origin[at] = total, (1, None)

    def best_path(self, word: str) -> list[int]:
        """Ids of the best-scoring pieces of a text that has ``SPACE`` for blanks."""
        n = len(word)
        best, origin = [None] * (n + 1), [None] * (n + 1)
        best[0], last, covered = 0.0, 0, False
        for end, (length, score, piece) in self.automaton.iter(word):
            end += 1
            if end != last:
                if not covered and last:
                    self._unknown(best, origin, last)
                for at in range(last + 1, end):
                    self._unknown(best, origin, at)
                last, covered = end, False
            # longest piece first, and a tie keeps what is there
            total = best[end - length] + score
            if best[end] is None or total > best[end]:
                best[end], origin[end] = total, (length, piece)
            if length == 1:
                covered = True
        if not covered and last:
            self._unknown(best, origin, last)
        for at in range(last + 1, n + 1):
            self._unknown(best, origin, at)
        path, at = [], n
        while at:
            length, piece = origin[at]
            at -= length
            if piece is None:
                path += [self.bytes[b] for b in reversed(word[at].encode())]
            else:
                path.append(piece)
        path.reverse()
        return path

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and how many each has."""
        if len(self.known) > CACHE:
            self._clear()
        known, counts, flat = self.known, self.counts, self.flat
        numbers = [np.zeros(0, dtype=np.int64)]  # the words of one text at a time are strings
        for t in texts:
            words = self.word.findall(self.prefix + t.decode("utf-8", "replace").replace(SPACE, " ")) if t else []
            for word in set(words).difference(known):
                path = self.best_path(word.replace(" ", SPACE))
                known[word] = len(counts)
                counts.append(len(path))
                flat.extend(path)
            numbers.append(np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words)))
        n_words = [len(x) for x in numbers[1:]]
        numbers = np.concatenate(numbers)
        sizes = np.array(counts, dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        per_word = sizes[numbers]
        ids = np.array(flat, dtype=np.uint32)[ranges(starts[numbers], per_word)]
        doc = np.repeat(np.arange(len(texts)), n_words)
        return ids, np.bincount(doc, per_word, minlength=len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray) -> str:
        """The text of pieces, without the blank put before a text."""
        data = b"".join(map(self.surfaces.__getitem__, ids.tolist()))
        text = data.decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def encoder(path: str) -> Encoder:
    """This process's encoder of a model file; later tasks find its words known."""
    return kept(__name__, path, lambda: Encoder(path))


def library_encoder(path: str) -> sentencepiece.SentencePieceProcessor:
    """The library's own unigram encoder with the same pieces and scores."""
    model = load_model(path)
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def encode_texts(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``ids`` of every row's whole text; an empty list for a null or empty one."""
    outputs = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return map_texts(docs, keep, text, outputs, _ids, path)


def round_trips(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``n_pieces``, ``ids_crc32`` (ids as little-endian unsigned 32-bit integers) and
    ``restored``: whether decoding the ids gives the text again (a null one as empty).

    Rows are encoded on their own, so repeated rows repeat their result; only the
    columns in ``keep`` pass through.
    """
    outputs = T.StructType(
        [
            T.StructField("n_pieces", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
            T.StructField("restored", T.BooleanType()),
        ]
    )
    return map_texts(docs, keep, text, outputs, _trips, path)


def _ids(path: str):
    def work(texts):
        ids, sizes = encoder(path).encode(texts)
        ends = np.cumsum(sizes)
        return [[ids[e - n : e].astype(np.int32) for e, n in zip(ends, sizes, strict=True)]]

    return work


def _trips(path: str):
    def work(texts):
        tool = encoder(path)
        ids, sizes = tool.encode(texts)
        ends = np.cumsum(sizes)
        own = [ids[e - n : e] for e, n in zip(ends, sizes, strict=True)]
        same = [
            tool.decode(x) == (t or b"").decode("utf-8", "replace")
            for x, t in zip(own, texts, strict=True)
        ]
        return [sizes, [zlib.crc32(x.astype("<u4").tobytes()) for x in own], same]

    return work
