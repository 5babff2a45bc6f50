"""Each corpus operator against a plain version on small documents, with the awkward cases among them."""

import hashlib
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]

import cases  # noqa: E402
import oracle  # noqa: E402
import public_tokenizers  # noqa: E402

from loomgraph import runtime  # noqa: E402
from loomgraph.llm import bm25, bpe, components, exact, jaccard, mixture, passages, phrases, quality, registry, sharding, suffixes, text, warc  # noqa: E402

#: A word of two letters such that it and the one with its letters exchanged have equal polynomial hashes modulo 2**64.
THUE = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
VOCABULARY = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def odd(spark):
    return cases.frame(spark, cases.odd_texts()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], cases.SCHEMA)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    oracle.assert_same(registry.queries()[name](spark, oracle.DATA), registry.oracle_sql()[name], oracle.connection())


# --- mixture


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    budget, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            return capped
        left, total = budget - sum(capped.values()), sum(weight[s] for s in free)
        now = {s: left * weight[s] / total for s in free}
        over = [s for s in free if now[s] > cap * sizes[s]]
        if not over:
            return capped | now
        capped |= {s: cap * sizes[s] for s in over}


def test_mixture_meets_targets(spark, odd):
    rng = random.Random(2)
    many = [(i, cases.words(rng.randint(1, 60), i), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(600)]
    for docs, items in ((odd, cases.odd_texts()), (cases.frame(spark, many), many)):
        rows = mixture.mix(docs).collect()
        sizes = {}
        for _, t, source in items:
            sizes[source] = sizes.get(source, 0) + len(cases.WORD.findall((t or "").encode()))
        want = plain_targets(sizes)
        assert len(rows) == len(items) and sum(r.source_size for r in rows if r.size >= 0) > 0
        assert all(0 <= r.taken <= 2 * r.size for r in rows)
        assert sorted({round(r.target, 6) for r in rows}) == sorted({round(v, 6) for v in want.values()})
        taken = {}
        for r in rows:
            taken[r.target] = taken.get(r.target, 0) + r.taken
        largest = max(r.size for r in rows)
        assert all(abs(t - got) <= largest for t, got in taken.items())
        assert sorted(map(str, rows)) == sorted(map(str, mixture.mix(docs).collect()))


def test_mixture_repeats_rows(spark, empty):
    docs = cases.frame(spark, [(i, "a b c", "s") for i in range(10)])
    out = mixture.repeated(docs)
    assert out.columns == docs.columns and out.count() == 15
    assert mixture.mix(empty).collect() == [] and mixture.repeated(empty).collect() == []
    assert [r.taken for r in mixture.mix(cases.frame(spark, [(1, None, None), (2, "", "x")])).collect()] == [0, 0]


# --- search


def test_search_is_exact_and_pruned(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(bm25, "SHARD_POSTINGS", 2000)
    monkeypatch.setattr(bm25, "BLOCK_DOCS", 4)
    items = [(i, cases.words(random.Random(i).randint(1, 40), i, 300), "s") for i in range(300)]
    docs = cases.frame(spark, items)
    got = bm25.search(docs, docs.where("doc_id % 20 = 0"), k=5).collect()
    texts = {i: [w.lower() for w in t.split()] for i, t, _ in items}
    n, average = len(texts), sum(map(len, texts.values())) / len(texts)
    df = {}
    for w in texts.values():
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    for q in range(0, 300, 20):
        scores = {}
        for d, w in texts.items():
            s = sum(np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / average)) for t in set(texts[q]) & set(w))
            if s:
                scores[d] = round(s, 6)
        want = sorted(scores, key=lambda d: (-scores[d], d))[:5]
        mine = sorted((r["rank"], r.doc_id, r.score) for r in got if r.query_id == q)
        assert [m[1] for m in mine] == want and all(abs(m[2] - scores[m[1]]) < 1e-5 for m in mine)
    found = bm25.search(odd, odd, k=3)
    assert found.where("query_id in (5, 6, 7)").count() == 0 and found.where("query_id = 12 and rank = 1").first().doc_id == 12
    assert bm25.search(empty, empty).collect() == [] and bm25.search(odd, empty).collect() == []


def test_blocks_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(bm25, "BLOCK_DOCS", 8)
    rng = random.Random(6)
    texts = [cases.words(rng.randint(20, 60), i, 400) for i in range(2000)]
    rare = "rare words of one story " + cases.words(10, 1, 400)
    texts[800:816] = [rare + " " + cases.words(5, i, 400) for i in range(16)]
    row = bm25.build_shards(cases.frame(spark, [(i, t, "s") for i, t in enumerate(texts)]).coalesce(1), "doc_id", "text").first().asDict()
    vocabulary, lengths = np.frombuffer(row["vocabulary"], "<u8"), np.diff(np.frombuffer(row["offsets"], "<i4"))

    def run(text, least=0.0):
        import pyarrow as pa

        shard = bm25.Shard(row, sum(len(t.split()) for t in texts) / len(texts))
        terms = next(bm25._terms(pa.array([text])))[2]
        df = lengths[np.searchsorted(vocabulary, terms)]
        docs, scores = shard.top(terms, np.log1p((2000 - df + 0.5) / (df + 0.5)), 10, least)
        return shard, set(shard.ids[docs].tolist()), scores

    shard, found, _ = run(rare)
    assert found <= set(range(800, 816)) and len(found) >= 10
    shard, found, scores = run(texts[5])
    kth = float(np.sort(scores)[-10])
    again, same, _ = run(texts[5], kth)
    assert same == found and 5 in same and again.skipped_blocks > 20 and run(texts[5], 10 * kth)[1] == set()


def test_many_queries_read_little_and_find_the_same(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bm25, "GROUP_DOCS", 200)
    rng = random.Random(9)
    # two languages of frequent words, rare words of both, copies, and texts of one word
    tongues = [[f"{x}{i}" for i in range(40)] for x in "pq"]
    texts = [" ".join(rng.choices(tongues[i % 2], k=rng.randint(10, 60)) + [f"r{rng.randint(0, 900)}" for _ in range(5)]) for i in range(1500)]
    texts[700:716] = [texts[3]] * 16
    texts[1000:1004] = ["p1", "q1", "r5", "p1 q1"]
    row = bm25.build_shards(cases.frame(spark, [(i, t, "s") for i, t in enumerate(texts)]).coalesce(1), "doc_id", "text").first().asDict()
    average = sum(len(t.split()) for t in texts) / len(texts)
    asked = [*range(0, 1500, 10), 1001, 1002, 1003]
    per_query = [next(bm25._terms(pa.array([texts[q]])))[2] for q in asked]
    offs = np.concatenate(([0], np.cumsum([len(t) for t in per_query])))
    terms, which = np.unique(np.concatenate(per_query), return_inverse=True)
    vocabulary, lengths = np.frombuffer(row["vocabulary"], "<u8"), np.diff(np.frombuffer(row["offsets"], "<i4"))
    df = lengths[np.searchsorted(vocabulary, terms)]
    idf = np.log1p((1500 - df + 0.5) / (df + 0.5))
    shard = bm25.Shard(row, average)
    # scores by the formula, from the inverted lists
    norm = bm25.K1 * (1 - bm25.B + bm25.B * np.frombuffer(row["lengths"], "<i8") / average)
    counts, lists = np.frombuffer(row["counts"], "<i4"), np.repeat(np.arange(len(lengths)), lengths)
    docs = np.frombuffer(row["docs"], "<i4")
    want = []
    for t in per_query:
        factor = np.zeros(len(vocabulary))
        factor[np.searchsorted(vocabulary, t)] = idf[np.searchsorted(terms, t)]
        all_scores = np.round(np.bincount(docs, factor[lists] * counts * (bm25.K1 + 1) / (counts + norm[docs]), 1500), bm25.PLACES)
        best = [i for i in np.lexsort((shard.ids, -all_scores))[:10].tolist() if all_scores[i] > 0]
        want.append([(int(shard.ids[i]), float(all_scores[i])) for i in best])

    def run(least):
        shard = bm25.Shard(row, average)
        query, found, scores = shard.tops(offs, which, terms, idf, 10, np.array(least))
        for q, best in enumerate(want):
            mine = sorted(zip((-scores[query == q]).tolist(), shard.ids[found[query == q]].tolist()))
            assert [m[1] for m in mine] == [b[0] for b in best] and all(abs(m[0] + b[1]) < 3e-6 for m, b in zip(mine, best)), q
        return shard

    assert shard.n_groups > 1 and any(m.shape[1] for m in shard.matrices)
    run([0.0] * len(asked))
    again = run([best[-1][1] if len(best) == 10 else 0.0 for best in want])
    assert 5 * again.read < again.listed and again.skipped_blocks > 100


def test_words_of_equal_polynomials_are_two_terms(spark):
    docs = cases.frame(spark, [(1, THUE, "s"), (2, THUE.translate(str.maketrans("ab", "ba")), "s"), (3, "x", "s")])
    assert {(r.query_id, r.doc_id) for r in bm25.search(docs, docs).collect()} == {(1, 1), (2, 2), (3, 3)}


# --- suffix arrays


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(0)
    for trial in range(60):
        t = np.append(rng.integers(1, 4, int(rng.integers(1, 120))) if trial % 3 else np.tile([1, 2], 40), 0).astype(np.int32)
        plain = t.tolist()
        assert suffixes.suffix_array(t, 5).tolist() == sorted(range(len(plain)), key=lambda i: plain[i:])
    pieces = [bytes(rng.integers(97, 99, int(rng.integers(0, 40))).astype(np.uint8)) for _ in range(6)]
    times = np.array([1, 2, 1, 1, 1, 3])
    whole = [p for p, n in zip(pieces, times) for _ in range(n)]
    for p, flags in zip(pieces, suffixes.recurring(pieces, times, 5)):
        assert flags.tolist() == [sum(q.startswith(p[i : i + 5], j) for q in whole for j in range(len(q))) > 1 for i in range(len(p) - 4)]


@pytest.mark.parametrize("hot", [1, 1_000])
def test_substring_dedup(spark, odd, empty, monkeypatch, hot):
    monkeypatch.setattr(passages, "HOT_OCCURRENCES", hot)
    rows = suffixes.substring_dedup(odd).collect()
    want = cases.plain_substrings([t for _, t, _ in cases.odd_texts()], suffixes.WINDOW)
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == sorted(want)
    by_id = {r.doc_id: r.n_removed for r in rows if r.doc_id is not None}
    assert by_id[1] == by_id[2] == len(cases.odd_texts()[0][1]) and by_id[5] == 0 and by_id[15] > 0
    assert suffixes.substring_dedup(empty).collect() == []


# --- sharding


def test_sharding(spark, odd, empty):
    many = cases.frame(spark, [(i, "x" * (i % 50), "abcc"[i % 4]) for i in range(5000)])
    for docs, n in ((many, 5000), (odd, len(cases.odd_texts()))):
        rows = sharding.shard(docs).collect()
        counts = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(16)}
        assert len(rows) == n and max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
        assert all(c == list(range(len(c))) for c in counts.values())
        assert all(r.law == "rows" and r.grown_shard is None for r in rows)
    for source, share in (("a", 1250), ("c", 2500)):
        got = [sum(r.source == source and r.shard == s for r in sharding.shard(many).collect()) for s in range(16)]
        assert max(got) - min(got) <= 3 and abs(sum(got) - share) == 0
        break
    one = {r.doc_id: r for r in sharding.shard(odd).collect()}
    assert one[17].size == len(cases.odd_texts()[16][1].encode()) + 1 and one[17].text_crc32 == zlib.crc32(cases.odd_texts()[16][1].encode()) and one[5].size == 1
    assert sharding.shard(empty).collect() == []


# --- phrases


@pytest.mark.parametrize("hot,partitions", [(1, 20_000), (1_000, 20_000), (1_000, 2), (1, 2)])
def test_phrase_dedup(spark, odd, empty, monkeypatch, hot, partitions):
    monkeypatch.setattr(passages, "HOT_OCCURRENCES", hot)
    monkeypatch.setattr(passages, "MOST_PARTITIONS", partitions)  # several shards in one partition
    monkeypatch.setattr(phrases, "SHARD_BYTES", 20_000)
    rows = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in phrases.phrase_dedup(odd).collect() if r.doc_id is not None}
    known = [(i, t) for i, t, _ in cases.odd_texts() if i is not None]
    for (i, _), want in zip(known, cases.plain_phrases(known, phrases.WINDOW)):
        assert rows[i] == want, i
    assert phrases.phrase_dedup(empty).collect() == []


def test_automaton_finds_every_occurrence():
    letters = phrases.Alphabet([[b"a", b"b"], [b"c"]])
    assert letters.spell([b"a", b"c", b"a"]) == letters.spell([b"a"]) + letters.spell([b"c"]) + letters.spell([b"a"])
    found, n = phrases.occurrences(["abcabc", "zabcz"], [1, 1], 1, 3)
    assert n == 1 and found == [[(0, 0, 1), (3, 0, 1)], [(1, 0, 1)]]
    assert phrases.occurrences(["abcd"], [1], 1, 3) == ([[]], 0)
    assert phrases.occurrences(["abcde", "xyz"], [2, 1], 1, 3, [True, False]) == ([[(0, 0, 3)], []], 1)


# --- exact dedup


def test_perfect_hash():
    digests = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(5000)), np.uint8).reshape(-1, 32)
    hashed = exact.PerfectHash.load(exact.PerfectHash(digests).dump())
    assert sorted(hashed.slots(digests).tolist()) == list(range(5000))
    assert len(exact.PerfectHash(digests[:0]).slots(digests)) == 5000


def test_exact_dedup(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(exact, "SHARD_DIGESTS", 5)
    rows = exact.exact_dedup(odd).collect()
    groups = {}
    for i, t, _ in cases.odd_texts():
        groups.setdefault(t or "", []).append(i)
    assert len(rows) == len(cases.odd_texts())
    for r in rows:
        own = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        known = [i for i in own if i is not None]
        assert r.doc_id in own and r.group_size == len(own) and r.keep_id == (max(known) if known else None) and r.kept == (r.doc_id == r.keep_id)
    assert exact.exact_dedup(empty).collect() == []


# --- quality


def test_quality(spark, odd, empty):
    rng = random.Random(4)
    good = [(i, cases.words(rng.randint(20, 80), i).capitalize() + ".", "s") for i in range(0, 400)]
    bad = [(i, " ".join(["SPAM!!"] * rng.randint(20, 80)) + " " + cases.words(5, i), "s") for i in range(400, 600)]
    docs = cases.frame(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 400), None) for i in range(600)], "doc_id long, quality int, toxic int")
    model = quality.learned(docs, labels)
    rows = quality.score(docs, model).collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == (r.doc_id < 400) for r in held]) > 0.97
    again = quality.score(docs, quality.learned(docs, labels)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    left = quality.accepted(docs, model)
    assert left.columns == docs.columns and left.count() == sum(r.predicted for r in rows)
    assert quality.score(odd, model).count() == len(cases.odd_texts()) and quality.score(empty, model).collect() == []
    nothing = quality.learned(empty, labels.limit(0))
    assert {r.score for r in quality.score(odd, nothing).collect()} == {1.0}


def test_pairwise_term_in_linear_time():
    rng = np.random.default_rng(1)
    m = quality.Machine()
    m.vectors = rng.normal(size=m.vectors.shape).astype(np.float32)
    index, value = np.array([3, 70, 9000]), np.array([0.5, 1.0, -2.0])
    plain = sum(float(m.vectors[i] @ m.vectors[j]) * x * y for a, (i, x) in enumerate(zip(index, value)) for j, y in zip(index[a + 1 :], value[a + 1 :]))
    assert abs(m._parts(index, value, np.array([0, 3]))[0][0] - plain) < 1e-3


def test_scores_equal_a_plain_machine(spark):
    """Features and scores, end to end, against loops over words and all pairs of features."""
    import collections
    import math

    items = [(i, cases.words(30, i).replace("w1", "W1, ") + "\n" + ("JUNK 99 " * (i % 7)) + "\nsame\nsame", "s") for i in range(60)] + [(60, None, "s"), (61, "", "s"), (62, "é. b?", "s")]
    docs = cases.frame(spark, items)
    labels = spark.createDataFrame([(i, int(i % 7 == 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    model = quality.learned(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    machine, scales = model.machine, model.scales
    for i, t, _ in items:
        raw = (t or "").encode()
        found = cases.WORD.findall(raw)
        lines = raw.split(b"\n") if raw else []
        lines = lines[:-1] if lines and lines[-1] == b"" else lines
        hashed = [int(h) >> (64 - quality.WORD_BITS) for w in found for h in [plain_polynomial(w)]]
        counts = collections.Counter(hashed)
        norm = math.sqrt(sum(c * c for c in counts.values()))
        features = {b: c / norm for b, c in counts.items()}
        size, n = len(raw), len(found)
        marks = [b for b in range(33, 127) if not chr(b).isalnum()]
        share = lambda test: sum(map(test, raw)) / max(size, 1)
        whole = [w + b"\n" if j + 1 < len(lines) or raw.endswith(b"\n") else w for j, w in enumerate(lines)]
        stats = [
            math.log1p(len(t or "")), math.log1p(size), math.log1p(n), size / max(n, 1), share(lambda b: 65 <= b < 91), share(lambda b: 48 <= b < 58), share(lambda b: b in marks),
            share(lambda b: b == 10), share(lambda b: b >= 0xC0), len(counts) / max(math.sqrt(n), 1), max(counts.values(), default=0) / max(n, 1),
            1 - len(set(whole)) / max(len(lines), 1), math.log1p(size / max(len(lines), 1)), sum(w[-1] in marks for w in found) / max(n, 1),
        ]
        m = len(stats)
        for j, x in enumerate(stats):
            features[quality.N_WORDS + j] = max(-3, min(3, (x - scales.mean[j]) / scales.spread[j])) / 3
            features[quality.N_WORDS + m + j * quality.BINS + sum(x >= e for e in scales.edges[j])] = 0.5
        z = machine.bias + sum(float(machine.linear[f]) * x for f, x in features.items())
        pairs = list(features.items())
        v = machine.vectors.astype(float)
        z += sum(float(v[a] @ v[b]) * x * y for k, (a, x) in enumerate(pairs) for b, y in pairs[k + 1 :])
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-4, i


def plain_polynomial(word):
    """The hash of a word by its definition."""
    p = sum((b + 1) * pow(text._BASE, k, 1 << 64) for k, b in enumerate(word)) % (1 << 64)
    return int(text.mix(np.array([p], np.uint64))[0])


# --- archives


def test_loser_tree():
    rng = random.Random(0)
    for k in range(9):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(12))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    monkeypatch.setattr(warc, "RANGE_ROWS", 4)
    big = "<p>é</p>\r\nWARC/1.1\r\n\r\n" * 100
    pages = [(1, "http://www.b.com/x", big), (2, "https://a.org:80/?q=1#f", big), (3, None, None), (4, "http://a.org/é\n%", "small"), (5, "x", "small"), (6, "http://b.com/x", big), (None, "u", "z" * 2000)]
    rows = warc.archive_and_index(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    got = {r.page_id: r for r in rows}
    assert len(rows) == 7 and len({r.archive for r in rows}) > 1
    for i, _, html in pages:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert {i: (got[i].record_type, got[i].refers_to) for i in (1, 2, 4, 5, 6)} == {1: ("revisit", 6), 2: ("revisit", 6), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    order = [(r.urlkey.encode(), r.ts) for r in rows]
    assert order == sorted(order) and got[1].urlkey == got[6].urlkey == "com,b)/x"
    assert warc.archive_and_index(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


# --- Jaccard join


@pytest.mark.parametrize("frequent,rounds,name_bytes", [(2, 1, 8), (100, 3, 1), (2, 0, 8)])
def test_components(spark, odd, empty, monkeypatch, frequent, rounds, name_bytes):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard, "PART_TOKENS", 3000)
    monkeypatch.setattr(jaccard, "_NAME_BYTES", name_bytes)  # with few names sets pass over those of others
    rng = random.Random(9)
    base = cases.words(90, 50).split()
    items = [(i, t, "s") for i, t, _ in cases.odd_texts() if i is not None]
    for i in range(100, 160):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        items.append((i, " ".join(w), "s"))
    items += [(200, THUE, "s"), (201, THUE.translate(str.maketrans("ab", "ba")), "s")]
    roots, sizes = cases.plain_components([t for _, t, _ in items])
    rows = {r.doc_id: r for r in jaccard.jaccard_components(cases.frame(spark, items)).collect()}
    for (i, _, _), root, n in zip(items, roots, sizes):
        assert (rows[i].n_shingles, rows[i].component_id) == (n, items[root][0]), i
    assert jaccard.jaccard_components(odd).count() == len(cases.odd_texts())
    assert jaccard.jaccard_components(empty).collect() == []


def test_thousands_of_near_copies(spark, monkeypatch):
    """A large group of near copies and strangers that share its beginning: plain components, and few pairs compared."""
    rng = random.Random(5)
    base, items = cases.words(70, 77).split(), []
    for i in range(2000):
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        items.append((i, " ".join(w), "s"))
    items += [(i, " ".join(base[:40]) + " " + cases.words(30, i), "s") for i in range(2000, 2200)]
    before, compared, verified = len(runtime.scratch_tables()), [], jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, sets: (compared.append(pairs.count()), verified(pairs, sets))[1])
    rows = {r.doc_id: r.component_id for r in jaccard.jaccard_components(cases.frame(spark, items)).collect()}
    roots, _ = cases.plain_components([t for _, t, _ in items])
    assert [rows[i] for i, _, _ in items] == [items[r][0] for r in roots]
    made = runtime.scratch_tables()[before:]
    keyed = spark.read.parquet(next(p for p in made if "jaccard-keys" in p)).count()
    assert sum(compared) < keyed < 2000 * 300


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(3)
    for trial in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = a.copy()
        change = rng.random(len(b)) < rng.choice([0.02, 0.1, 0.16])
        b[change] = rng.integers(0, 2**63, int(change.sum())).astype(np.uint64)
        b = np.unique(b)
        b = b[: int(len(b) * rng.choice([1.0, 0.9]))]
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 75 * (len(a) + len(b) - both):
            # how many sets have each token: these two and others
            times = {t: int((t in a) + (t in b) + rng.choice([0, 1, 60, 100])) for t in np.union1d(a, b).tolist()}
            found = []
            for x in (a, b):
                own = np.array([t for t in x.tolist() if times[t] > 1], np.uint64)
                found.append(jaccard.keys(own, np.array([times[t] for t in own.tolist()], np.int64), len(x)))
            (long_, _), (short, near) = found if len(a) >= len(b) else found[::-1]
            assert len(np.intersect1d(long_, short[near]))
        small = min(len(jaccard.folded(a)), len(jaccard.folded(b)))
        x, y = (f if len(f) == small else f[:small] ^ f[small:] for f in (jaccard.folded(a), jaccard.folded(b)) if len(f) <= 2 * small)
        unequal = int(np.unpackbits((x ^ y).view(np.uint8)).sum())
        assert unequal <= len(a) + len(b) - 2 * both


def test_suffixes_of_many_symbols_in_order():
    rng = np.random.default_rng(3)
    for size in (5, 1 << 16, (1 << 16) + 1, 1 << 20):
        symbols = np.append(rng.integers(0, size, 3_000), [size - 1, 0])
        assert suffixes._stable(symbols, size).tolist() == np.argsort(symbols, kind="stable").tolist()
    t = np.append(rng.permutation(np.repeat(np.arange(1, 70_000), 2)), 0)
    order = suffixes.suffix_array(t, 70_000)
    place = np.empty(len(t), np.int64)
    place[order] = np.arange(len(t))
    a, b = order[:-1], order[1:]
    assert sorted(order.tolist()) == list(range(len(t)))
    assert ((t[a] < t[b]) | ((t[a] == t[b]) & (place[np.minimum(a + 1, len(t) - 1)] < place[np.minimum(b + 1, len(t) - 1)]))).all()


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    root = {}
    for a, b in edges:
        x, y = root.setdefault(a, a), root.setdefault(b, b)
        low = min(x, y)
        root = {k: low if v in (x, y) else v for k, v in root.items()}
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    alone = {a for a, b in edges if a == b}
    want = {(k, v) for k, v in root.items() if k != v or any(v == w and k != j for j, w in root.items())}
    assert {(r.node, r.component) for r in got.collect()} == want and alone is not None


@pytest.mark.parametrize("task_edges,most_jobs", [(500_000, 8), (50, 1_000)])
def test_connected_components_of_a_long_path(spark, monkeypatch, task_edges, most_jobs):
    monkeypatch.setattr(components, "TASK_EDGES", task_edges)
    order = random.Random(2).sample(range(400), 400)
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(5, 5), (900, 901)], "a long, b long")
    spark.sparkContext.setJobGroup("path", "path")
    try:
        got = {(r.node, r.component) for r in components.connected_components(edges).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {(i, 0) for i in range(400)} | {(900, 900), (901, 900)}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("path")) <= most_jobs


def test_each_stage_starts_with_a_driver_that_gave_back(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    jvm = spark.sparkContext._jvm
    weak = jvm.java.lang.ref.WeakReference(jvm.Object())
    times = []
    monkeypatch.setattr(runtime, "driver_gives_back", lambda s, f=runtime.driver_gives_back: (times.append(1), f(s)))
    docs = cases.frame(spark, ["a b c d e f", "a b c d e f", "x"]).select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:2]:
        stage(spark, docs, str(tmp_path))
    assert len(times) == 2 and weak.get() is None


# --- byte-level BPE


def test_bpe_equals_the_library(spark, odd, empty):
    import tiktoken

    ranks = bpe.read_ranks(VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = [t for _, t, _ in cases.odd_texts()] + ["".join(rng.choice("ab \n'st1½éʰ̀x\x1c 日.,#") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += [f"{chr(c)} {chr(c)}a{chr(c)}1" for c in (*range(1, 0x400), 0x2028, 0x3000, 0xFF21)] + ["<|endoftext|>"]
    out = bpe.encode_texts([t or "" for t in texts], VOCABULARY, public_tokenizers.PATTERN)
    for t, packed in zip(texts, out):
        assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(t or "")
        assert bpe.decode_ids(packed, VOCABULARY, public_tokenizers.PATTERN) == (t or "").encode()
    rows = bpe.encode(odd, VOCABULARY, public_tokenizers.PATTERN, with_ids=True).collect()
    want = sorted((len(library.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for _, t, _ in cases.odd_texts())
    assert sorted((r.n_tokens, r.decoded_sha256) for r in rows) == want and all(len(r.ids) == r.n_tokens for r in rows)
    assert bpe.encode(empty, VOCABULARY, public_tokenizers.PATTERN).collect() == []


def test_merges_that_open_lower_ranks():
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"bc": 400, b"ab": 300, b"cd": 299, b"abcd": 257}
    replay = bpe.Replay(ranks)
    rng = random.Random(2)
    pieces = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    ids, offs = replay.encode(pieces)
    for i, p in enumerate(pieces):
        assert ids[offs[i] : offs[i + 1]].tolist() == (replay.encode_one(p) if p else [])


# --- kernels and pipeline


def test_words_and_runs():
    import pyarrow as pa

    texts = [t or "" for _, t, _ in cases.odd_texts()]
    for limit in (50, 1 << 18):
        seen = []
        for _, _, data, offs in text.chunks(pa.array(texts), limit):
            starts, ends, word_offs = text.words(data, offs)
            seen += [[data[a:b].tobytes() for a, b in zip(starts[x:y], ends[x:y])] for x, y in zip(word_offs[:-1], word_offs[1:])]
            doc, start, n, anchor = text.runs(data.astype(np.uint64), offs, 30, 8)
            assert np.bincount(doc, n, len(offs) - 1).tolist() == np.maximum(np.diff(offs) - 29, 0).tolist()
        assert seen == [cases.WORD.findall(t.encode()) for t in texts]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(i, 1, 0) for i in range(1, 22)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = cases.frame(spark, cases.odd_texts()).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixture", "encode"]
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    counts = [now.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"out{i}"))
        now = spark.read.parquet(str(tmp_path / f"out{i}"))
        counts.append(now.count())
    kept = {r.doc_id for r in spark.read.parquet(str(tmp_path / "out2")).collect()}
    assert counts[1] > counts[2] > counts[3] and 8 in kept and not {1, 2} <= kept and counts[4] == counts[5]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == counts[5]


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    """Repeated and missing ids, repeated rows, names that the operators use themselves, and no rows at all."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    base, near = cases.words(80, 1), cases.words(80, 1).replace(" ", "  ") + " tail"
    other = cases.words(80, 2)
    items = [(1, base, "a"), (1, base, "a"), (1, near, "a"), (None, near, None), (None, base, "b"), (None, near, None), (2, other, "b"), (2, other, "c"), (3, None, "a"), (4, "", "a"), (None, " ", "a")]
    names = ["text_sha256", "__hash", "__copies", "__source", "__copy", "__s", "__total", "gone_id", "kept", "id", "digest", "__row", "keep_id", "component_key", "__quality_text"]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(*i, *(f"{n}!" for n in names)) for i in items], schema).cache()

    def texts(name):
        out = stages[name](spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        rows = out.collect()
        assert all(r[n] == f"{n}!" for r in rows for n in names)
        assert stages[name](spark, docs.where("false"), str(tmp_path)).collect() == []
        return sorted(((r.doc_id, r.text) for r in rows), key=str)

    assert texts("quality") == sorted(((i, t) for i, t, _ in items), key=str)
    assert texts("exact_dedup") == sorted([(1, base), (1, near), (2, other), (4, ""), (None, " ")], key=str)
    kept = texts("near_dedup")
    assert len([1 for _, t in kept if t in (base, near)]) == 1 and (None, base) not in kept and (None, near) not in kept
    assert sorted((i, t) for i, t in kept if t == other) == [(2, other)] and {(3, None), (4, ""), (None, " ")} <= set(kept)
    assert set(texts("mixture")) <= {(i, t) for i, t, _ in items}
    out = stages["encode"](spark, docs, str(tmp_path)).collect()
    assert len(out) == len(items) and stages["encode"](spark, docs.where("false"), str(tmp_path)).collect() == []


def test_archives_of_pages_without_ids(spark):
    big = "p" * 1500
    rows = warc.archive_and_index(spark.createDataFrame([(5, "u", big), (None, "u", big), (None, "v", "q" * 1200), (None, "w", "q" * 1200)], "page_id long, url string, html string")).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in rows if r.payload_bytes == 1500) == [("5", "response", None), ("None", "revisit", 5)]
    assert {(r.record_type, r.refers_to) for r in rows if r.payload_bytes == 1200} == {("response", None)}


def test_sample_of_documents_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_ROWS", 5)
    seen = []
    learn = quality.Machine.learn
    monkeypatch.setattr(quality.Machine, "learn", lambda self, i, x, offs, label, **k: (seen.append(len(label)), learn(self, i, x, offs, label, **k))[1])
    docs = cases.frame(spark, [(i % 40, cases.words(20, i), "s") for i in range(2000)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    quality.learned(docs, labels)
    assert seen == [5]
