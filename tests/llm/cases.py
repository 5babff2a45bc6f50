"""Documents that every operator must cope with, and plain versions of what the operators compute."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, kept boolean, node long, start long"


def rows(texts):
    """Rows with columns whose names clash with the operators' own."""
    out = []
    for i, item in enumerate(texts):
        doc_id, text, source = item if isinstance(item, tuple) else (i, item, f"s{i % 3}")
        out.append((doc_id, text, "en", source, len(text or ""), 7, 7, True, 7, 7))
    return out


def words(n, seed, vocabulary=4000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_texts():
    """Nulls, empty and very long texts, copies, near copies, shared passages, repeats within a text, odd spaces."""
    base, passage, long_ = words(120, 1), words(30, 2), words(9000, 3)
    near = base.split()
    near[60] = "changed"
    return [
        (1, base, "a"), (2, base, "a"), (3, base, None), (4, " ".join(near), "b"), (5, None, "b"), (6, "", "b"), (7, " \t\n ", None), (8, long_, "c"),
        (9, words(50, 4) + " " + passage + " " + words(50, 5), "c"), (10, words(60, 6) + "\n" + passage + "\t" + words(20, 7), "c"), (11, passage, "a"),
        (12, "one two three", "a"), (13, "One two  three", "a"), (14, "one two", "a"), (15, ("ha " * 300).strip(), "b"), (16, "x" * 5000, "b"),
        (17, "é ñ 日本     😀 " * 40, "b"), (18, long_ + " tail", "c"), (19, "one two three", None), (None, words(40, 8), "a"), (None, None, None), (21, base.upper(), "a"),
    ]


def frame(spark, items):
    return spark.createDataFrame(rows(items), SCHEMA)


def plain_substrings(texts, window):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - window + 1):
            if seen[d[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def plain_phrases(docs, window):
    """docs: (id, text) in the order in which occurrences count."""
    seen, out = set(), []
    for _, text in docs:
        w = WORD.findall((text or "").encode())
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def plain_sets(texts):
    out = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode())
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def plain_components(texts):
    sets = plain_sets(texts)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(sets))], list(map(len, sets))
