"""Small tables with every awkward case, and plain brute-force versions."""

from __future__ import annotations

import random
import re
from collections import Counter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words int"


def awkward(spark):
    """Null, empty, blank, very long, repeated and odd texts; clashing extra columns."""
    long = " ".join(f"word{i % 997} the" for i in range(20_000))
    texts = [
        None, "", "   \n\t ", "one", "the cat sat on the mat and the dog ran off.\nAll rights reserved.",
        "the cat sat on the mat and the dog ran off.\nAll rights reserved.", long, "日本語 テキスト ☃ é",
        "12 34 !! ??", "x" * 50_000, "Licensed under CC BY-NC 4.0.", "A\u0000B <|endoftext|> c",
    ]
    rows = [(i, t, ["en", None][i % 2], None, None, 0.5, i) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "no key at all in this row", "en", "s", 1, None, None)]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def plain_words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low)


def contamination(rows, texts, window=10):
    """(n_words, n_hit, sorted items) of each text, by looking at every place."""
    patterns = {}
    for item, text in rows:
        w = plain_words(text)
        for at in range(max(len(w) - window + 1, 1) if w else 0):
            patterns.setdefault(tuple(w[at : at + window]), set()).add(str(item))
    sizes, out = {len(p) for p in patterns}, []
    for text in texts:
        w, hit, items = plain_words(text), set(), set()
        for n in sizes:
            for at in range(len(w) - n + 1):
                if (found := patterns.get(tuple(w[at : at + n]))) is not None:
                    hit.update(range(at, at + n))
                    items |= found
        out.append((len(w), len(hit), sorted(items)))
    return out


def near_duplicates(rows):
    """Sorted (doc_id, n_shingles, component_id), comparing every pair that shares a shingle."""
    sets, root = [], list(range(len(rows)))
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for k, s in enumerate(sets):
        shared = Counter(j for g in s for j in holders.get(g, ()))
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                root[find(k)] = find(j)
        for g in s:
            holders.setdefault(g, []).append(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(s), least[find(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def copies(seed, groups=30):
    """Groups of near copies, chains of edits, cut texts and exact copies."""
    rnd, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rnd.randint(0, 30 if g % 2 else 500)}" for _ in range(rnd.randint(3, 70))]
        for _ in range(rnd.randint(1, 14)):
            x = base[:]
            for _ in range(rnd.randint(0, 3)):
                x[rnd.randrange(len(x))] = f"z{rnd.randint(0, 50)}"
            if rnd.random() < 0.3:
                x = x[: rnd.randint(1, len(x))]
            if rnd.random() < 0.3:
                base = x
            rows.append((len(rows) * 7 % 1009, " ".join(x)))
    return rows
