"""Each operator on awkward rows, and against brute force, the library or a round trip."""

import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from helpers import awkward, contamination, copies, empty, near_duplicates, plain_words
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidemark.llm import (
    block_search, common, decontam, jaccard, license_scan, piece_viterbi, token_counts, token_files,
)

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def texts_of(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_cut_keeps_rows_in_order_and_long_texts_alone():
    import pyarrow as pa

    sizes = [3, 0, 50, 2, 2, 9, None]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([b"x" * n if n is not None else None for n in sizes], pa.binary())], names=["t"])
    parts = [p.column(0).to_pylist() for p in common.cut(batch, 0, 10)]
    assert sum(parts, []) == batch.column(0).to_pylist()
    assert all(sum(len(t or b"") for t in p) <= 10 or len(p) == 1 for p in parts)


def test_process_keeps_what_one_operator_needs(monkeypatch):
    import weakref

    import pyarrow as pa

    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([b"a b c"])], names=["ref", "text"])
    pieces = weakref.ref(piece_viterbi.encoder(PIECES))
    assert piece_viterbi.encoder(PIECES) is pieces()
    list(common.tidy(lambda batches: batches, piece_viterbi.__name__)([batch]))
    assert pieces() is not None and len(given) == 1
    list(common.tidy(jaccard._sets)([batch]))
    assert pieces() is None and len(given) == 2
    # a task that is left early gives back as well
    left = common.tidy(jaccard._sets)([batch, batch])
    next(left)
    left.close()
    assert len(given) == 3


def test_worker_drops_what_the_operator_before_kept(spark):
    import pyarrow as pa

    def others(batches):
        for batch in batches:
            n = sum(owner != jaccard.__name__ for owner, _ in common._kept)
            yield pa.RecordBatch.from_arrays([pa.array([n] * batch.num_rows, pa.int64())], names=["n"])

    docs = spark.range(64).selectExpr("id AS doc_id", "concat('some words ', id) AS text").repartition(8)

    def most(run):
        return docs.select("doc_id").mapInArrow(run, "n long").agg(F.max("n")).first()[0]

    piece_viterbi.encode_texts(docs, PIECES, ["doc_id"]).collect()
    assert most(others) == 1
    assert most(common.tidy(others, jaccard.__name__)) == 0


def test_pieces_hold_the_words_of_one_text_at_a_time():
    import tracemalloc

    tool = piece_viterbi.Encoder(PIECES)
    texts = [b"ab cd. " * 3000] * 40
    alone = tool.encode(texts[:1])
    tracemalloc.start()
    ids, sizes = tool.encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids.tolist() == alone[0].tolist() * 40 and sizes.tolist() == alone[1].tolist() * 40
    assert peak < 120 * len(texts) * 6000


# -- token counts and files ---------------------------------------------------


def library_ids(texts):
    tokenizer = Tokenizer.from_file(WORDS)
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


ODD = ["ΑΣ Σ'S İx ǅ ﬁ", "don't  DON'T 'll've '' 's", "á é ́x", "１２ ٣ ½ ²x", "\x1c a\x1fb \x85 c",
       "<|startoftext|>Hi<|endoftext|> <|endoftext|", "naïve ÀÉÎ ÷×ß ŸŽ", "a b c　d", "😀 👨‍👩‍👧 🇩🇪", "�​"]


def test_long_texts_are_split_at_blanks(monkeypatch):
    rnd = random.Random(3)
    text = " ".join(rnd.choices([*ODD, "plain words", "== = =", "<|endoftext|>x", "\n\t"], k=400))
    texts = [text, "", None, "x" * 500 + " y", text[:50]]
    expected = library_ids(texts)
    for size in (1 << 20, 64, 7):
        monkeypatch.setattr(token_counts, "SLICE_BYTES", size)
        monkeypatch.setattr(token_counts, "CACHE", size)
        for with_ids in (True, False):
            table = token_counts.Pretokens(WORDS, with_ids)
            raw = [t.encode() if t is not None else None for t in texts]
            if with_ids:
                ids, sizes = table.encoded(raw)
                assert np.split(ids, np.cumsum(sizes)[:-1])[0].tolist() == expected[0]
                assert ids.tolist() == sum(expected, [])
            assert token_counts.counts(table, raw)[1].tolist() == [len(e) for e in expected]


def test_pretokens_equal_the_library():
    rnd = random.Random(1)
    letters = "abcXYZ'’.,!? \n\té ßÜΣ1²日☃́<|>"
    texts = ODD + ["".join(rnd.choices(letters, k=rnd.randint(0, 40))) for _ in range(3000)]
    table = token_counts.Pretokens(WORDS, with_ids=True)
    ids, sizes = table.encoded([t.encode() for t in texts])
    ends = np.cumsum(sizes)
    got = [ids[e - n : e].tolist() for e, n in zip(ends, sizes, strict=True)]
    assert got == library_ids(texts)


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE", 5)
    table = token_counts.Pretokens(WORDS, with_ids=False)
    texts = [f"some{i} words{i} here" for i in range(50)]
    got = [int(token_counts.counts(table, [t.encode()])[1][0]) for t in texts]
    assert got == list(map(len, library_ids(texts)))


def test_full_cache_keeps_the_frequent_pretokens(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE", 8)
    made = []
    pieces = token_counts.Pretokens._pieces
    monkeypatch.setattr(token_counts.Pretokens, "_pieces", lambda self, n: made.append(n) or pieces(self, n))
    table, tokenizer = token_counts.Pretokens(WORDS, with_ids=True), Tokenizer.from_file(WORDS)
    for k in range(40):
        texts = [f"the unto{k}ward über the", f"über rar{k}ity x{k}ß"]
        flat, n = table.encoded([t.encode() for t in texts])
        want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert flat.tolist() == sum(want, []) and n.tolist() == [len(w) for w in want]
        assert len(table.known) <= 8 + 12 and len(table.counts) == len(table.known)
    assert made.count("the") == 1 and made.count("über") == 1


def test_count_tokens_on_awkward_rows(spark):
    docs = awkward(spark)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, WORDS, ["doc_id"]).collect()}
    texts = texts_of(docs)
    expected = dict(zip(texts, library_ids(texts.values()), strict=True))
    assert got == {k: (len((texts[k] or "").encode()), len(expected[k])) for k in texts}
    assert token_counts.count_tokens(empty(spark), WORDS, ["doc_id"]).count() == 0


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_blocks_of_ids_round_trip(n):
    values = np.random.default_rng(n).integers(0, 2 ** np.repeat([8, 16, 24, 32], 250)[:n], dtype=np.uint64)
    values = values.astype(np.uint32)
    assert (token_files.unpack(token_files.pack(values)) == values).all()


def test_token_files_in_key_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 50)
    docs = awkward(spark)
    folder = token_files.write(docs, str(tmp_path / "ids"), WORDS, 2)
    found = token_files.read(spark, folder, T.LongType(), token_files.checksum,
                             T.StructType([T.StructField("crc", T.LongType())])).collect()
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    start, expected = 0, []
    for (key, _), ids in zip(rows, library_ids([t for _, t in rows]), strict=True):
        ids = np.array([*ids, 2], dtype="<u4")
        expected.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, found), key=lambda r: r[1]) == expected
    blank = token_files.write(empty(spark), str(tmp_path / "none"), WORDS, 2)
    assert token_files.read(spark, blank, T.LongType(), token_files.checksum,
                            T.StructType([T.StructField("crc", T.LongType())])).count() == 0


# -- pieces -------------------------------------------------------------------


def test_viterbi_equals_the_library():
    rnd, tool = random.Random(2), piece_viterbi.Encoder(PIECES)
    library = piece_viterbi.library_encoder(PIECES)
    letters = "abthequick  \n\té☃1290.,;()²."
    texts = ["", " ", "  a  b ", "日本語 ☃ \U0001f600x", "a" * 3000, "▁x ▁▁ y", *ODD[:4]]
    texts += ["".join(rnd.choices(letters, k=rnd.randint(0, 40))) for _ in range(3000)]
    ids, sizes = tool.encode([t.encode() for t in texts])
    ends = np.cumsum(sizes)
    for text, end, n in zip(texts, ends, sizes, strict=True):
        own = ids[end - n : end]
        assert own.tolist() == library.encode(text), text
        assert tool.decode(own) == text.replace("▁", " ")


def test_pieces_of_awkward_rows(spark):
    docs = awkward(spark)
    rows = piece_viterbi.round_trips(docs, PIECES, ["doc_id"]).collect()
    assert len(rows) == docs.count() and all(r.restored for r in rows)
    ids = {r.doc_id: r.ids for r in piece_viterbi.encode_texts(docs, PIECES, ["doc_id"]).collect()}
    assert ids[0] == [] and ids[1] == []
    assert all(len(ids[r.doc_id]) == r.n_pieces for r in rows)
    assert piece_viterbi.round_trips(empty(spark), PIECES, ["doc_id"]).count() == 0


def test_a_model_of_ranks_is_not_far_from_its_own_encoding():
    own = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    text = "The quick brown fox jumps over the lazy dog, and nobody minds very much."
    ids, _ = piece_viterbi.Encoder(PIECES).encode([text.encode()])
    assert len(ids) <= 1.3 * len(own.encode(text))


# -- neighbours ---------------------------------------------------------------


@pytest.mark.parametrize("components", [block_search.GROUP_COMPONENTS, 100])
def test_nearest_with_ties_copies_and_unusable_vectors(spark, monkeypatch, components):
    monkeypatch.setattr(block_search, "GROUP_COMPONENTS", components)  # one group, or many
    rnd, rows = random.Random(4), []
    for i in range(300):
        v = [float(rnd.randint(-2, 2)) for _ in range(rnd.choice([3, 3, 3, 2]))]
        if i % 37 == 0:
            v = None
        elif i % 41 == 0:
            v = [float("nan"), 1.0, 2.0]
        elif i % 43 == 0:
            v = [None, 1.0, 2.0]
        elif i % 47 == 0:
            v = []
        rows.append((i, v, i))
    rows += [*rows[20:40], (None, [1.0, 2.0, 3.0], 0)]
    rows += [(1000 + i, [2.0, 2.0, -0.0 if i % 2 else 0.0], 0) for i in range(70)]  # more copies than any list holds
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = sorted(map(tuple, block_search.nearest(frame, F.col("vec_id") % 20 == 0, 20).collect()))
    usable = {i: v for i, v, _ in rows if i is not None and v and any(v)
              and all(x is not None and math.isfinite(x) for x in v)}
    expected = []
    for i, v in usable.items():
        if i % 20 == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j)
                          for j, w in usable.items() if j != i and len(w) == len(v))
            expected += [(i, r, j, -s) for r, (s, j) in enumerate(near[:20], 1)]
    assert got == sorted(expected)
    assert block_search.nearest(frame.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_tiles_lose_no_neighbour_to_quantisation():
    random_ = np.random.default_rng(3)
    x = random_.normal(size=(700, 1100)) * random_.lognormal(0, 3, size=(700, 1))
    ids = np.arange(700)
    block = lambda rows: (ids[rows], x[rows], *block_search.quantise(x[rows]))
    sizes, near, scores = block_search.tile(block(slice(0, 40)), block(slice(None)), 10)
    exact = x[:40] @ x.T
    exact[np.arange(40), np.arange(40)] = -np.inf
    assert (sizes == 10).all()
    assert (np.sort(near.reshape(40, 10)) == np.sort(np.argsort(-exact, axis=1)[:, :10])).all()
    assert np.allclose(scores, np.take_along_axis(exact, near.reshape(40, 10), 1).ravel())


# -- decontamination ----------------------------------------------------------


def test_fm_index_equals_brute_force():
    rnd = random.Random(2)
    for _ in range(150):
        letters = ["a", "b", "c", "d", "é"][: rnd.randint(1, 5)]
        rows = [(i, " ".join(rnd.choices(letters, k=rnd.randint(0, 14)))) for i in range(rnd.randint(0, 6))]
        texts = [" ".join(rnd.choices([*letters, "zz"], k=rnd.randint(0, 60))) for _ in range(8)]
        known = decontam.phrases([(i, t.encode()) for i, t in rows])
        found = decontam.find(known, [t.encode() for t in texts])
        got = [(n, int((s[:, 1] - s[:, 0]).sum()), items) for n, s, items in found]
        assert got == contamination(rows, texts)


BENCHMARK = [(1, "The cat sat, on the mat and the dog ran OFF today"), (2, "no key at all"), (2, "no key at all"),
             (3, None), (4, ""), (None, "under cc by")]


@pytest.mark.parametrize("limit", [1 << 24, 20])
def test_contamination_of_awkward_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(decontam, "PASS_BYTES", limit)  # 20: several passes
    docs = awkward(spark)
    benchmark = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    rows = docs.select("doc_id", "text").collect()
    expected = contamination([(i, t) for i, t in BENCHMARK], [r.text for r in rows])
    expected = [(r.doc_id, n, hit, [x for x in items if x != "None"])
                for r, (n, hit, items) in zip(rows, expected, strict=True)]
    found = decontam.contamination(docs, benchmark, ["doc_id"]).collect()
    got = [(r.doc_id, r.n_words, sum(b - a for a, b in r.spans), r["items"]) for r in found]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert any(hit for _, _, hit, _ in expected)
    cut = decontam.without_spans(docs, benchmark, length="n_chars")
    assert cut.columns == docs.columns and cut.count() == docs.count()
    left = contamination([(i, t) for i, t in BENCHMARK], [r.text for r in cut.collect()])
    assert not any(hit for _, hit, _ in left)
    clean = {i for i, _, hit, _ in expected if not hit}
    assert all(r.text == texts_of(docs)[r.doc_id] for r in cut.collect() if r.doc_id in clean)
    assert decontam.contamination(empty(spark), benchmark, ["doc_id"]).count() == 0
    nothing = decontam.contamination(docs, benchmark.where("false"), ["doc_id"])
    assert nothing.where(F.size("spans") > 0).count() == 0


def test_passes_cut_what_one_pass_cuts(spark, monkeypatch):
    w = [f"w{i}" for i in range(30)]
    # overlapping items, and a window that stands only after a cut
    items = [w[:20], w[14:26], ["a"] * 5 + ["b"] * 5, ["c"] * 10]
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    texts = [w, ["a"] * 5 + w[:20] + ["b"] * 5 + ["d"], ["a"] * 5 + ["c"] * 10 + w[14:26] + ["b"] * 5, ["d"], []]
    docs = spark.createDataFrame(
        [(i, " ".join(t), 0) for i, t in enumerate(texts)] + [(9, None, None)], "doc_id long, text string, n int")
    cut = {}
    for limit in (1 << 24, 20):
        monkeypatch.setattr(decontam, "PASS_BYTES", limit)
        found = decontam.without_spans(docs, benchmark, length="n")
        assert found.schema == docs.schema
        cut[limit] = sorted(map(tuple, found.collect()))
    assert cut[20] == cut[1 << 24]
    assert cut[20][0][1].split() == w[26:] and cut[20][1][1].split() == ["d"]


# -- licenses -----------------------------------------------------------------


def plain_license_blocks(template, words):
    """Best containment of any block of a template, None without one; by looking at every block."""
    split, own, best = template.text.split(), set(template.text.split()), None
    size = max(license_scan.SPREAD * len(split), license_scan.LEAST_BLOCK)
    for i, word in enumerate(words):
        if word not in own:
            continue
        block = words[i : i + size]
        block = block[: min([len(block), *(k for k, w in enumerate(block) if w in template.excluded)])]
        share = len(own & set(block)) / len(own)
        if share >= 0.8 - 1e-9 and set(template.required) <= set(block):
            best = max(best or 0, share)
    return best


def test_license_join_equals_brute_force():
    rnd, letters, hits = random.Random(3), [f"w{i}" for i in range(8)], 0
    for _ in range(300):
        templates = []
        for i in range(4):
            text = rnd.choices(letters, k=rnd.randint(1, 7))
            others = [w for w in letters if w not in text]
            templates.append(license_scan.Template(
                f"t{i}", " ".join(text), tuple(set(rnd.choices(text, k=rnd.randint(0, 1)))),
                tuple(rnd.sample(others, rnd.choice([0, 0, 1])))))
        index = license_scan.build_index({w.encode(): rnd.randint(0, 5) for w in letters}, tuple(templates))
        for _ in range(10):
            words = rnd.choices([*letters, "x", "y", "z"], k=rnd.randint(0, 40))
            found = {t.label: plain_license_blocks(t, words) for t in templates}
            row = license_scan.scan(index, " ".join(words).encode())
            assert row[5] == sorted(x for x, share in found.items() if share)
            assert row[6] == pytest.approx(max([0, *(s for s in found.values() if s)]))
            hits += len(row[5])
    assert hits > 500


@pytest.mark.parametrize("text, labels", [
    ("Released under the Apache license.", []),
    ("Licensed under the Apache License, Version 2.0 (the License)", ["apache-2.0"]),
    ("Licensed under the EUPL License, Version 2.0", []),
    ("This work is licensed under the GNU General Public License version 2", ["gpl", "gpl-2.0"]),
    ("This work is licensed under the GNU General Public License version 3", ["gpl", "gpl-3.0"]),
    ("This work is licensed under the GNU Lesser General Public License version 3", ["gpl", "lgpl"]),
    ("Licensed under the GNU Affero General Public License, version 3", ["agpl", "gpl"]),
    ("Licensed under CC BY 4.0", ["cc-by", "cc-by-4.0"]),
    ("Licensed under CC BY-SA 4.0", ["cc-by", "cc-by-sa-4.0"]),
    ("Licensed under CC BY-NC 4.0", ["cc-by", "cc-by-nc-4.0"]),
    ("Licensed under CC BY-NC-ND 4.0", ["cc-by", "cc-by-nc-nd-4.0"]),
    ("Licensed under CC BY 4.0. Photographs are CC BY-NC 4.0.", ["cc-by", "cc-by-4.0", "cc-by-nc-4.0"]),
    ("All rights reserved. MIT students may not copy this.", ["all-rights-reserved", "reserved"]),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated "
     "documentation files (the \"Software\"), to deal\nin the Software without restriction, including without "
     "limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the "
     "Software", ["mit"]),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby "
     "granted", ["isc"]),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License", ["gpl", "gpl-3.0"]),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ["mpl-2.0"]),
])
def test_a_notice_gives_its_own_label_only(text, labels):
    assert license_labels(text) == labels
    assert license_labels("word " * 50 + text.replace(" ", "\n") + " word" * 50) == labels


def test_licenses_of_awkward_rows(spark):
    docs = awkward(spark)
    found = {r.doc_id: r for r in license_scan.scan_licenses(docs, ["doc_id"]).collect()}
    for key, text in texts_of(docs).items():
        words, row = plain_words(text), found[key]
        places = [(i, label) for phrase, label in license_scan.PHRASES.items()
                  for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        assert (row.n_words, row.n_base) == (len(words), len(places))
        assert row.first_word == min((i for i, _ in places), default=None)
        assert row.last_word == max((i for i, _ in places), default=None)
        assert row.base_labels == sorted({x for _, x in places})
        assert set(row.base_labels) <= set(row.labels) and 0 <= row.score <= 1
    assert found[10].labels == ["cc-by", "cc-by-nc-4.0"]
    assert license_scan.scan_licenses(empty(spark), ["doc_id"]).count() == 0


def license_labels(text):
    index = license_scan.build_index({}, license_scan.TEMPLATES)
    return license_scan.scan(index, text.encode())[5]


def test_licenses_do_not_depend_on_line_ends():
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted"
    assert license_labels(bsd) == license_labels(bsd.replace("\n", " ")) == ["bsd"]
    assert license_labels("# Released under\n# the MIT\n# License.\n") == ["mit"]
    for t in license_scan.TEMPLATES:
        assert license_labels(t.text.replace(" ", "\r\n")) == license_labels(t.text)
        assert t.label in license_labels(t.text)
    # scattered over a long line
    scattered = "and".join(f" {w} " + "x " * 40 for w in bsd.lower().replace(",", "").split())
    assert license_labels(scattered) == []
    assert license_labels(scattered + bsd) == ["bsd"]


def test_license_blocks_cover_every_match():
    rnd = random.Random(8)
    for _ in range(200):
        ranks, size = rnd.randint(1, 6), rnd.randint(2, 9)
        text = rnd.choices(range(-12, ranks), k=rnd.randint(0, 60))
        entry = license_scan.Entry("t", list(range(ranks)), rnd.randint(1, ranks), size, set(), set())
        places = [(i, r) for i, r in enumerate(text) if r >= 0]
        wanted = {i: len({r for r in text[i : i + size] if r >= 0}) for i, _ in places}
        wanted = {i: n for i, n in wanted.items() if n >= entry.least}
        got = list(license_scan.blocks(places, entry))
        assert all(past <= first for (_, past, _), (first, _, _) in zip(got, got[1:]))
        assert all(sum(a <= i < b for a, b, _ in got) == 1 for i in wanted)
        assert [n for _, _, n in got] == [max(n for i, n in wanted.items() if a <= i < b) for a, b, _ in got]


# -- near duplicates ----------------------------------------------------------


@pytest.mark.parametrize("seed", [5, 6])
def test_components_equal_brute_force(spark, seed):
    rows = copies(seed) + [(5000, None), (5001, ""), (5002, " \t"), (5003, "a b"), (5004, "A  B")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = near_duplicates(rows)
    got = jaccard.near_duplicates(docs).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect())) == expected
    if seed == 5:
        kept = sorted(r.doc_id for r in jaccard.one_of_each(docs).collect())
        assert kept == sorted({c for _, _, c in expected})


def test_near_duplicates_of_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)  # the way by a shuffle
    docs = awkward(spark)
    found = jaccard.near_duplicates(docs).collect()
    assert len(found) == docs.count()
    by_key = {r.doc_id: (r.n_shingles, r.component_id) for r in found}
    assert by_key[0] == (0, 0) and by_key[1] == (0, 1) and by_key[2] == (0, 2)
    assert by_key[4] == by_key[5] == (10, 4)
    assert by_key[None] == (3, None)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [
        i for i in range(12) if i != 5]
    assert kept.where("doc_id is null").count() == 1
    assert jaccard.near_duplicates(empty(spark)).count() == 0
    assert jaccard.one_of_each(empty(spark)).count() == 0


def test_components_of_chains_and_cycles(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    frame = spark.createDataFrame([(b, a) if a % 3 else (a, b) for a, b in links], "a long, b long")
    got = {r.node: r.root for r in jaccard.components(frame).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
