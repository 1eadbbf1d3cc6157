"""License scans by exact set-similarity join of text blocks with templates.

Line ends do not bound a block: a block is any run of ``SPREAD`` times as many words
as the template has, ``LEAST_BLOCK`` at least.  Two sets of words, a template *t* and
a block *b*, match if ``|t & b| >= THRESHOLD * |t|``.  The words that tell a license from
others are not left to the threshold: a template names words that must be in the block, and
words before which it ends.  Words are ordered by how many documents
of the whole corpus hold them, rarest first; words outside the templates cannot
add to an overlap and are dropped.  With ``least = ceil(THRESHOLD * |t|)``:

* required: a match holds every word that must be there;
* prefix: a match shares one of the first ``|t| - least + 1`` words of *t*, and of
  the first ``|b| - least + 1`` of *b*;
* length: a match has ``|b| >= least``;
* position: at the first shared word, the words left on either side must allow
  ``least``.

The filters are put to the set of a whole text, which holds every block's.  What passes
is counted exactly, block by block from each word of the template on; blocks that
overlap are one match with the best containment of them.  Beside the templates, three fixed phrases are found
word by word.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, map_texts, prepare

THRESHOLD = 0.8
#: Words of a block for each word of the template, and words of the shortest block.
SPREAD, LEAST_BLOCK = 2, 10

#: Phrase and label of the base scan.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}


@dataclass(frozen=True)
class Template:
    """A notice, the label it gives, the words that a block must have, and those that end one."""

    label: str
    text: str
    required: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()


_GNU = "this program is free software you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation"
_CC = ("by", "sa", "nc", "nd")


def _creative_commons(*terms: str) -> Template:
    return Template(
        "-".join(("cc", *terms, "4.0")), f"licensed under cc {' '.join(terms)} 4 0", ("cc", *terms, "4"),
        tuple(t for t in _CC if t not in terms),
    )


#: Notices of well-known licenses: headers, permission texts and one-line forms.
TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache", "2")),
    Template("mit", "released under the mit license", ("mit",)),
    Template("mit", "licensed under the mit license", ("mit",)),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ("sublicense",),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("fee",), ("sublicense",),
    ),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu", "general", "3"), ("lesser", "affero")),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu", "general", "2"), ("lesser", "affero", "3")),
    Template("gpl-3.0", f"{_GNU.format('general public license')} either version 3", ("gnu", "general", "3"), ("lesser", "affero")),
    Template("gpl-2.0", f"{_GNU.format('general public license')} either version 2", ("gnu", "general", "2"), ("lesser", "affero", "3")),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu", "lesser"), ("affero",)),
    Template("agpl", "licensed under the gnu affero general public license", ("gnu", "affero"), ("lesser",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla", "2")),
    _creative_commons("by"), _creative_commons("by", "sa"), _creative_commons("by", "nc"),
    _creative_commons("by", "nd"), _creative_commons("by", "nc", "sa"), _creative_commons("by", "nc", "nd"),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted",
        ("redistribution", "binary"),
    ),
    Template("no-warranty", "provided as is without warranty of any kind", ("warranty",)),
    Template("all-rights-reserved", "all rights reserved", ("reserved",)),
)

#: Lower-cases A-Z; blanks all but digits, letters and bytes from 0x80 on; keeps line ends.
_LINES = bytes(
    c + 32 if 65 <= c <= 90
    else c if c == 10 or 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)

OUTPUTS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.ArrayType(T.StringType())),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("score", T.DoubleType()),
        T.StructField(
            "matches",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("label", T.StringType()),
                        T.StructField("first_word", T.LongType()),
                        T.StructField("n_words", T.LongType()),
                        T.StructField("containment", T.DoubleType()),
                    ]
                )
            ),
        ),
    ]
)


@dataclass
class Entry:
    """A template as ranks."""

    label: str
    ranks: list[int]
    least: int
    size: int
    required: set[int]
    excluded: set[int]


@dataclass
class Index:
    """Templates in corpus order, and which have a word in their prefix."""

    rank: dict[bytes, int]
    templates: list[Entry]
    by_prefix: dict[int, list[tuple[int, int]]]  # rank: template, place in it
    shortest: int


def template_words(templates: tuple[Template, ...]) -> set[bytes]:
    """The words of all templates, those that must not stand in a block as well."""
    lists = [x.encode().translate(_LINES).split() for t in templates for x in (t.text, *t.required, *t.excluded)]
    return set().union(*lists)


def build_index(frequency: dict[bytes, int], templates: tuple[Template, ...],
                threshold: float = THRESHOLD) -> Index:
    """Order template words by document frequency (ties by the word)."""
    words = sorted(template_words(templates), key=lambda w: (frequency.get(w, 0), w))
    rank = {w: i for i, w in enumerate(words)}
    out, by_prefix = [], defaultdict(list)
    for t in sorted(templates, key=lambda t: (t.label, t.text)):
        split = t.text.encode().translate(_LINES).split()
        ranks = sorted({rank[w] for w in split})
        least = math.ceil(threshold * len(ranks) - 1e-9)
        for place, r in enumerate(ranks[: len(ranks) - least + 1]):
            by_prefix[r].append((len(out), place))
        out.append(Entry(
            t.label, ranks, least, max(SPREAD * len(split), LEAST_BLOCK),
            {rank[w.encode()] for w in t.required}, {rank[w.encode()] for w in t.excluded},
        ))
    return Index(rank, out, dict(by_prefix), min((x.least for x in out), default=0))


def candidates(index: Index, block: list[int]) -> list[int]:
    """Place of every template that a sorted list of ranks matches, in order."""
    found, seen, have = [], set(), set(block)
    for i, r in enumerate(block):
        for t, j in index.by_prefix.get(r, ()):
            if t in seen:
                continue
            entry = index.templates[t]
            if len(block) < entry.least or i > len(block) - entry.least:
                continue
            # the first shared word, as the block is read in order
            seen.add(t)
            if 1 + min(len(block) - i - 1, len(entry.ranks) - j - 1) < entry.least:
                continue
            if entry.required <= have and len(have.intersection(entry.ranks)) >= entry.least:
                found.append(t)
    return sorted(found)


def blocks(places: list[tuple[int, int]], entry: Entry) -> Iterator[tuple[int, int, int]]:
    """First word, word past the last and best overlap of each run of matching blocks.

    ``places`` are (word position, rank) of the template's words, and of those that end a
    block, in order of position.
    """
    inside: Counter = Counter()
    own = set(entry.ranks)
    begin = end = best = past = 0
    for k, (first, rank) in enumerate(places):
        if k and (left := places[k - 1][1]) in own:
            inside[left] -= 1
            if not inside[left]:
                del inside[left]
        if rank not in own:
            past = k + 1
            continue
        while past < len(places) and places[past][0] < first + entry.size and places[past][1] in own:
            inside[places[past][1]] += 1
            past += 1
        if len(inside) < entry.least or not inside.keys() >= entry.required:
            continue
        if best and first >= end:
            yield begin, end, best
            best = end = 0
        begin = begin if best else first
        end, best = places[past - 1][0] + 1, max(best, len(inside))
    if best:
        yield begin, end, best


def scan(index: Index, text: bytes | None) -> tuple:
    """One row of ``OUTPUTS``."""
    plain = (text or b"").translate(_LINES)
    words = plain.split()
    hits, best, known = [], 0.0, index.rank
    base, labels = [], set()
    # most texts hold too few template words to match
    have = known.keys() & words
    if have and len(have) >= index.shortest:
        chosen = candidates(index, sorted(known[w] for w in have))
        places = [(i, known[w]) for i, w in enumerate(words) if w in known] if chosen else []
        for entry in (index.templates[t] for t in chosen):
            counted = entry.excluded.union(entry.ranks)
            for first, past, overlap in blocks([p for p in places if p[1] in counted], entry):
                share = overlap / len(entry.ranks)
                hits.append({"label": entry.label, "first_word": first, "n_words": past - first,
                             "containment": share})
                labels.add(entry.label)
                best = max(best, share)
    if any(p in plain for p in _PHRASE_STARTS):
        for phrase, label in _PHRASE_WORDS:
            at = -1
            while (at := _find(words, phrase[0], at + 1)) >= 0:
                if words[at : at + len(phrase)] == phrase:
                    base.append((at, label))
    if base:
        labels.update(x for _, x in base)
        best = 1.0
    starts = [a for a, _ in base]
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None),
        sorted({x for _, x in base}), sorted(labels), best, hits,
    )


_PHRASE_WORDS = [(p.encode().split(), label) for p, label in PHRASES.items()]
#: The rarest-looking word of each phrase: without it there is nothing to find.
_PHRASE_STARTS = [b"cc", b"license", b"reserved"]


def _find(words: list[bytes], word: bytes, start: int) -> int:
    try:
        return words.index(word, start)
    except ValueError:
        return -1


def document_frequency(docs: DataFrame, text: str, templates: tuple[Template, ...]) -> dict[bytes, int]:
    """How many documents hold each template word, over the whole table."""
    wanted = frozenset(template_words(templates))
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = defaultdict(int)
        for batch in batches:
            for part in cut(batch, 0):
                for t in part.column(0).to_pylist():
                    for w in wanted.intersection((t or b"").translate(_LINES).split()):
                        total[w] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())],
            names=["word", "n"],
        )

    rows = (
        docs.select(F.col(text).cast("string").cast("binary").alias("text"))
        .mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    )
    return {bytes(r.word): r.n for r in rows.collect()}  # at most the words of the templates


def scan_licenses(docs: DataFrame, keep: list[str], text: str = "text",
                  templates: tuple[Template, ...] = TEMPLATES,
                  threshold: float = THRESHOLD) -> DataFrame:
    """Base places, labels, best containment and every matching block of each row.

    A null text is empty: no words, no places, null first and last word, no labels,
    score 0.  Score is 1 where a base phrase stands, else the best containment of a
    matching block.  Rows are scanned on their own; only the columns in ``keep``
    pass through.
    """
    index = build_index(document_frequency(docs, text, templates), templates, threshold)
    return map_texts(docs, keep, text, OUTPUTS, _scanner, index)


def _scanner(index: Index):
    def work(texts):
        rows = [scan(index, t) for t in texts]
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in OUTPUTS]

    return work
