"""N-gram Jaccard join with token-combination prefixes, and the components of its links.

A document's tokens are its distinct shingles. With all tokens in one global order, two sets that are similar enough
share a token among the first few of each: the prefix. Here rare tokens come first in that order and frequent ones
last. Tokens are counted over the whole corpus; those that only one set has can bring nothing together, and a set
whose prefix holds no others is linked with nothing, which is how most documents end.

A longer prefix makes linked sets share k tokens. Rare tokens are indexed one by one; frequent ones, which alone would
bring too many sets together, only in combinations. Tokens are dealt into k - 1 parts by hash, and since k shared tokens
put two into one part, only pairs within a part are needed: their number stays in proportion to the set.

Components need no more pairs than it takes to connect them. In each of a few rounds every set is compared with one set
for each of its keys, the key's least in some order, unless both are in one component already. What is left
is compared across components: under each key all sets outside its largest component with all others. Of such a pair the
larger set has the key in its long prefix and the smaller one in its short prefix, so sets of like size need to share
more. Candidates pass an exact bound first: the tokens that a set shares with any other are folded into a bitmap of some
four times as many bits, a bit for the parity of the tokens that fall on it. Two sets differ in their tokens of no other
set and in as many others as their bitmaps differ in bits, at least. What passes is verified on the whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.components import connected_components
from loomgraph.llm.text import chunks, lower, mix, word_hashes, words
from loomgraph.runtime import lean, workers_can_import, written

#: Words of a shingle, and the least similarity of a link as a fraction.
SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100
#: Occurrences in COUNTED_TOKENS successive tokens of a task from which on a token is reported as common.
REPORTED = 3
COUNTED_TOKENS = 1_000_000
#: Common tokens that are made known to every worker at most; beyond it the mark is raised, which costs time only.
BROADCAST_TOKENS = 1_000_000
#: Sets under one token from which on it is frequent.
FREQUENT = 32
#: Tokens of a set for each part of the frequent tokens.
TOKENS_PER_PART = 16
#: Tokens that are counted at a time, how many such parts a partition has one after another, and the partitions of the
#: shuffle that brings them together at most.
PART_TOKENS = 1_000_000
PARTS_IN_TURN = 4
MOST_PARTITIONS = 20_000
#: Rounds that compare each set with one for each key.
ROUNDS = 2
#: Bits of a bitmap for each token, and the longs of the short bitmaps that are compared under every key.
BITS = 4
SHORT = 16
#: Sets that a task remembers so as to emit the tokens of equal ones once.
REMEMBERED_SETS = 1_000_000
#: Added to the count of a common token, so that all of them come after all others.
COMMON = 1 << 40


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document: of all words as one shingle if they are fewer than
    SHINGLE, and none without words."""
    low = lower(data)
    starts, ends, word_offs = words(low, offs)
    hashes = word_hashes(low, starts, ends)
    total = len(hashes)
    shingles = np.zeros(max(0, total - SHINGLE + 1), np.uint64)
    for i in range(SHINGLE):
        shingles = mix(shingles + hashes[i : i + len(shingles)] + np.uint64(i + 1))
    for a, b in zip(word_offs[:-1].tolist(), word_offs[1:].tolist()):
        if b - a >= SHINGLE:
            yield np.unique(shingles[a : b - SHINGLE + 1])
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for i, h in enumerate(hashes[a:b]):
                whole = mix(whole + h + np.uint64(i + 1))
            yield mix(whole ^ np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


#: Bytes of a set's name. Sets are named by the first of a digest's so many bytes that names no other set.
_NAME_BYTES = 8


def name(tokens: np.ndarray, taken: frozenset[int] = frozenset()) -> tuple[int, int]:
    """A set's name, which passes over those in ``taken``, and 64 more bits of its digest."""
    raw, step = tokens.tobytes(), 0
    while True:
        digest = hashlib.blake2b(raw, digest_size=16, salt=step.to_bytes(8, "little")).digest()
        node = int.from_bytes(digest[:_NAME_BYTES], "little", signed=True)
        if node not in taken:
            return node, int.from_bytes(hashlib.blake2b(raw, digest_size=8, person=b"check").digest(), "little", signed=True)
        step += 1


def folded(tokens: np.ndarray) -> np.ndarray:
    """The bitmap of a set, as longs: of the least power of two of bits, at SHORT longs least, that is no less than BITS
    times its size."""
    bits = max(64 * SHORT, 1 << (BITS * max(1, len(tokens)) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _scan(docs: DataFrame, taken: frozenset[int]) -> DataFrame:
    """A row for each document (__id, __hash, node, check, n), and rows (token, seen) for tokens that are common in a
    batch."""
    names = ["__id", "__hash", "node", "check", "n", "token", "seen"]

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        token, seen = np.unique(np.concatenate(held), return_counts=True)
        often = seen >= REPORTED
        token, seen = pa.array(token[often].view(np.int64)), pa.array(seen[often].astype(np.int64))
        return pa.RecordBatch.from_arrays([*[pa.nulls(len(token), pa.int64())] * 5, token, seen], names)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        of_batch: set[int] = set()
        total = 0
        for batch in batches:
            node, check, n = [], [], []
            for _, _, data, offs in chunks(batch.column(2)):
                for found in shingle_sets(data, offs):
                    a, b = name(found, taken) if len(found) else (None, None)
                    node.append(a)
                    check.append(b)
                    n.append(len(found))
                    if a not in of_batch:
                        of_batch.add(a)
                        held.append(found)
                        total += len(found)
                if total >= COUNTED_TOKENS:
                    yield counted(held)
                    held, of_batch, total = [], set(), 0
            found_in = [pa.array(v, pa.int64()) for v in (node, check, n)]
            nothing = [pa.nulls(len(n), pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found_in, *nothing], names)
        if total:
            yield counted(held)

    return docs.mapInArrow(run, "__id bigint, __hash bigint, node bigint, check bigint, n bigint, token bigint, seen bigint")


def _named(docs: DataFrame) -> tuple[DataFrame, DataFrame, frozenset[int]]:
    """What _scan returns, the distinct sets, and the names that two sets would share and neither has."""
    taken: frozenset[int] = frozenset()
    while True:
        scanned = written(_scan(docs, taken), "jaccard-documents", few_files=True)
        nodes = written(
            scanned.where("n > 0")
            .groupBy("node")
            .agg(
                F.min(F.struct(F.col("__id").isNull().alias("no_id"), "__id")).alias("first"),
                F.min("check").alias("least_check"),
                F.max("check").alias("most_check"),
                F.first("n").alias("n"),
            ),
            "jaccard-nodes",
        )
        shared = frozenset(row[0] for row in nodes.where("least_check <> most_check").select("node").collect())
        if not shared:
            return scanned, nodes, taken
        taken |= shared


def common_tokens(scanned: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Common tokens in ascending order, and how often each was reported, which is no more than it occurs. At most
    BROADCAST_TOKENS. They only shape the order of tokens, and any order gives the same links."""
    counts = written(scanned.where("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")), "jaccard-tokens")
    least = REPORTED
    while counts.where(F.col("seen") >= least).count() > BROADCAST_TOKENS:
        least *= 2
    table = counts.where(F.col("seen") >= least).toArrow()
    token = table["token"].to_numpy().view(np.uint64)
    order = np.argsort(token)
    return token[order], table["seen"].to_numpy()[order].astype(np.int64)


def size_class(n: int) -> int:
    """Sets that can be linked lie in one class or in neighbouring ones."""
    c, top = 0, 1
    while top * 4 // 3 + 1 <= n:
        top = top * 4 // 3 + 1
        c += 1
    return c


_bottoms: list[int] = [1]


def parts(c: int) -> int:
    """Into how many parts the frequent tokens of sets of class ``c`` are dealt."""
    while len(_bottoms) <= c:
        _bottoms.append(_bottoms[-1] * 4 // 3 + 1)
    return max(1, _bottoms[c] // TOKENS_PER_PART)


def prefix_length(n: int, k: int = 1) -> int:
    """So many first tokens of a set of ``n`` contain ``k`` tokens shared with each set that it is linked with."""
    need = -(-NUMERATOR * n // DENOMINATOR)
    return min(n, n - need + k)


def short_prefix(n: int, k: int = 1) -> int:
    """The same for sets that are no smaller."""
    need = -(-2 * NUMERATOR * n // (NUMERATOR + DENOMINATOR))
    return min(n, n - need + k)


def keys(tokens: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys under which a set of ``n`` tokens is indexed, and which of them lie in its short prefix. Given are the
    tokens that other sets have too, and in how many sets they are. Of two linked sets the larger one has a key that
    lies in the short prefix of the other."""
    order = np.lexsort((tokens, counts))
    tokens, frequent = tokens[order], counts[order] > FREQUENT
    alone = n - len(tokens)  # tokens of no other set come first
    c = size_class(n)

    def first(k: int, length=prefix_length) -> int:
        return max(0, length(n, k) - alone)

    if not frequent[: first(parts(c) + 1)].any():
        out = tokens[: first(1)]
        return out, np.arange(len(out)) < first(1, short_prefix)
    longest, shortest = first(parts(c) + 1), first(parts(c) + 1, short_prefix)
    rare = np.flatnonzero(~frequent[:longest])
    out, short = [tokens[rare]], [rare < shortest]
    for tag in {c, max(0, c - 1)}:
        g = parts(tag)
        end, near = first(g + 1), first(g + 1, short_prefix)
        at = np.flatnonzero(frequent[:end])
        own = tokens[at]
        if len(own) == 1 or n < g + 1:
            out.append(own)
            short.append(at < near)
        part = mix(own) % np.uint64(g)
        by = np.argsort(part, kind="stable")
        own, part, at = own[by], part[by], at[by]
        ends = np.searchsorted(part, part, "right")
        times = ends - np.arange(len(own)) - 1
        left = np.repeat(np.arange(len(own)), times)
        right = left + 1 + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        lo, hi = np.minimum(own[left], own[right]), np.maximum(own[left], own[right])
        out.append(mix(lo + mix(hi + np.uint64(tag + 1))))
        short.append(np.maximum(at[left], at[right]) < near)
    found, short_of = np.concatenate(out), np.concatenate(short)
    order = np.lexsort((~short_of, found))
    found, short_of = found[order], short_of[order]
    once = np.concatenate((np.ones(min(1, len(found)), bool), found[1:] != found[:-1]))
    return found[once], short_of[once]


#: Tokens of a part with the sets that have them: nodes, their sizes, tokens by planes of bytes, and the number of each
#: token's set. If ``counts`` is there, the tokens are common ones and pass through.
BLOB = "part bigint, nodes binary, sizes binary, tokens binary, owners binary, counts binary"


def _blob(part: int, nodes: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, owner: np.ndarray, counts: np.ndarray | None) -> tuple:
    which, owner = np.unique(owner, return_inverse=True)
    narrow = owner.astype("<u2" if len(which) <= 1 << 16 else "<u4")
    planes = np.ascontiguousarray(tokens.astype(">u8").view(np.uint8).reshape(-1, 8).T)  # sorted tokens have like first bytes
    return part, nodes[which].astype("<i8").tobytes(), sizes[which].astype("<i4").tobytes(), planes.tobytes(), narrow.tobytes(), None if counts is None else counts.astype("<i8").tobytes()


def _open(row: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, size, token, count) of each entry of a blob."""
    _, nodes, sizes, tokens, owners, counts = row
    nodes, sizes = np.frombuffer(nodes, "<i8"), np.frombuffer(sizes, "<i4")
    token = np.ascontiguousarray(np.frombuffer(tokens, np.uint8).reshape(8, -1).T).view(">u8").reshape(-1).astype(np.uint64)
    owner = np.frombuffer(owners, "<u2" if len(nodes) <= 1 << 16 else "<u4").astype(np.int64)
    return nodes[owner], sizes[owner], token, np.frombuffer(counts, "<i8") if counts is not None else np.zeros(0, np.int64)


def _dealt(docs: DataFrame, taken: frozenset[int], known: tuple[np.ndarray, np.ndarray], n_parts: int) -> DataFrame:
    """The tokens of each set, dealt into parts by value; common ones by their set."""
    shared = docs.sparkSession.sparkContext.broadcast(known)
    bounds = [-(-(p << 64) // n_parts) for p in range(1, n_parts)]

    def blobs(nodes: list[int], sets: list[np.ndarray]) -> Iterator[tuple]:
        common, reported = shared.value
        nodes_, sizes = np.array(nodes, np.int64), np.array([len(s) for s in sets])
        token, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
        order = np.argsort(token)
        token, owner = token[order], owner[order]
        if len(common):
            at = np.minimum(np.searchsorted(common, token), len(common) - 1)
            is_common = common[at] == token
            if is_common.any():
                part = int(mix(nodes_[:1].view(np.uint64))[0] % np.uint64(n_parts))
                yield _blob(part, nodes_, sizes, token[is_common], owner[is_common], reported[at[is_common]] + COMMON)
            token, owner = token[~is_common], owner[~is_common]
        cuts = np.concatenate(([0], np.searchsorted(token, np.array(bounds, np.uint64)), [len(token)]))
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            yield _blob(p, nodes_, sizes, token[cuts[p] : cuts[p + 1]], owner[cuts[p] : cuts[p + 1]], None)

    def batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), *[pa.binary()] * 5]
        held, size = [], 0
        for row in rows:
            held.append(row)
            size += len(row[3])
            if size >= 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], [c.split()[0] for c in BLOB.split(", ")])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], [c.split()[0] for c in BLOB.split(", ")])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        nodes: list[int] = []
        sets: list[np.ndarray] = []
        total = 0
        for batch in batches:
            for _, _, data, offs in chunks(batch.column(0)):
                for tokens in shingle_sets(data, offs):
                    if not len(tokens):
                        continue
                    node = name(tokens, taken)[0]
                    if node in seen:
                        continue
                    if len(seen) < REMEMBERED_SETS:
                        seen.add(node)
                    nodes.append(node)
                    sets.append(tokens)
                    total += len(tokens)
                if total >= COUNTED_TOKENS:
                    yield from batched(blobs(nodes, sets))
                    nodes, sets, total = [], [], 0
        if total:
            yield from batched(blobs(nodes, sets))

    return docs.mapInArrow(run, BLOB)


def _partitions(n_parts: int) -> int:
    return max(1, min(-(-n_parts // PARTS_IN_TURN), MOST_PARTITIONS))


def _met(dealt: DataFrame, n_parts: int) -> DataFrame:
    """(node, n, token, count) of the tokens that two sets or more have. Parts come one after another in a partition."""

    def counted(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        opened = [_open(r) for r in rows]
        node, size, token = (np.concatenate([o[i] for o in opened]) for i in range(3))
        order = np.argsort(token, kind="stable")
        token = token[order]
        edge = np.concatenate(([True], token[1:] != token[:-1], [True]))
        plural = ~(edge[:-1] & edge[1:])  # not alone
        token, order = token[plural], order[plural]
        if not len(token):
            return
        node, size = node[order], size[order]
        order = np.lexsort((node, token))
        token, node, size = token[order], node[order], size[order]
        once = np.concatenate(([True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])))
        token, node, size = token[once], node[once], size[once]
        first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        count = np.diff(np.append(first, len(token)))
        count = np.repeat(count, count)
        yield rows_of(node[count > 1], size[count > 1], token[count > 1], count[count > 1])

    def rows_of(node: np.ndarray, size: np.ndarray, token: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(size.astype(np.int32)), pa.array(token.view(np.int64)), pa.array(count.astype(np.int64))], ["node", "n", "token", "count"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for i in range(batch.num_rows):
                row = tuple(batch.column(c)[i].as_py() for c in range(6))
                if row[5] is not None:
                    yield rows_of(*_open(row))
                    continue
                if held and held[0][0] != row[0]:
                    yield from counted(held)
                    held = []
                held.append(row)
        if held:
            yield from counted(held)

    return dealt.repartition(_partitions(n_parts), "part").sortWithinPartitions("part").mapInArrow(run, "node bigint, n int, token bigint, count bigint")


def _indexed(met: DataFrame, n_parts: int) -> DataFrame:
    """(node, n, tokens, bits, keys, short) of the sets that have keys: their tokens that other sets have, too, and the
    bitmap of these."""
    names = ["node", "n", "tokens", "bits", "keys", "short"]
    long_list, bool_list = pa.list_(pa.int64()), pa.list_(pa.bool_())

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = [np.zeros(0, t) for t in (np.int64, np.int32, np.int64, np.int64)]
        for batch in chain(batches, [None]):
            if batch is None:
                columns, ready = rest, len(rest[0])
            else:
                columns = [np.concatenate((r, batch.column(i).to_numpy())) for i, r in enumerate(rest)]
                # the last node may go on in the next batch
                ready = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0
            rest = [c[ready:] for c in columns]
            node, n, token, count = (c[:ready] for c in columns)
            first = np.flatnonzero(np.concatenate((np.ones(min(1, ready), bool), node[1:] != node[:-1])))
            out = []
            for a, b in zip(first.tolist(), [*first[1:].tolist(), ready]):
                own, where = np.unique(token[a:b].view(np.uint64), return_index=True)  # common tokens may come from several tasks
                found, short = keys(own, count[a:b][where], int(n[a]))
                if len(found):
                    out.append((int(node[a]), int(n[a]), own.view(np.int64), folded(own), found.view(np.int64), short))
            if out:
                kinds = [pa.int64(), pa.int32(), long_list, long_list, long_list, bool_list]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names)

    sorted_ = met.repartition(_partitions(n_parts), "node").sortWithinPartitions("node")
    return sorted_.mapInArrow(run, "node bigint, n int, tokens array<bigint>, bits array<bigint>, keys array<bigint>, short array<boolean>")


def close(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps allow to be similar enough."""
    alone = F.col("n") - F.size("tokens")
    left = sets.select(F.col("node").alias("x"), F.col("n").alias("m"), F.col("bits").alias("s"), alone.alias("only_x"))
    right = sets.select(F.col("node").alias("y"), "n", F.col("bits").alias("t"), alone.alias("only_y"))
    joined = pairs.join(left, F.col("a") == F.col("x")).join(right, F.col("b") == F.col("y"))
    sizes = F.col("m") + F.col("n")
    may_differ = sizes - 2 * F.ceil(sizes * NUMERATOR / F.lit(NUMERATOR + DENOMINATOR))

    def halved(bits: Column) -> Column:
        half = (F.size(bits) / 2).cast("int")
        return F.zip_with(F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda u, v: u.bitwiseXOR(v))

    # sets that can be linked have bitmaps of one size, or one has twice the other's
    s = F.when(F.size("s") > F.size("t"), halved(F.col("s"))).otherwise(F.col("s"))
    t = F.when(F.size("t") > F.size("s"), halved(F.col("t"))).otherwise(F.col("t"))
    unequal = F.aggregate(F.zip_with(s, t, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda total, x: total + x)
    fits = F.least("m", "n") * DENOMINATOR >= F.greatest("m", "n") * NUMERATOR
    return joined.where(fits).where(unequal + F.col("only_x") + F.col("only_y") <= may_differ).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets (node, n, tokens) are similar enough."""
    left = sets.select(F.col("node").alias("x"), F.col("n").alias("m"), F.col("tokens").alias("s"))
    right = sets.select(F.col("node").alias("y"), "n", F.col("tokens").alias("t"))
    joined = pairs.join(left, F.col("a") == F.col("x")).join(right, F.col("b") == F.col("y"))
    both = F.size(F.array_intersect("s", "t")).cast("long")
    return joined.where(both * DENOMINATOR >= NUMERATOR * (F.col("m") + F.col("n") - both)).select("a", "b")


def _links(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """The links among candidate pairs, as a written table."""
    return written(verified(close(pairs, sets), sets), name)


def _labelled(frame: DataFrame, found: DataFrame | None) -> DataFrame:
    """``frame`` with the component of ``node``: itself if it has no links."""
    if found is None:
        return frame.withColumn("component", F.col("node"))
    joined = frame.join(found.select(F.col("node").alias("__v"), F.col("component").alias("__c")), F.col("node") == F.col("__v"), "left")
    return joined.withColumn("component", F.coalesce("__c", "node")).drop("__v", "__c")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _starred(labelled: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of each set with the least of its key in the order of a turn, if they lie in different components.

    In the first turn keys have one order, so sets that share most keys meet the same few; later, when few sets are left
    apart, each key has its own, so that these meet many."""
    order = F.xxhash64("node") if not turn else F.xxhash64("node", "key", F.lit(turn))
    least = labelled.groupBy("key").agg(F.min(F.struct(order.alias("h"), "node", "component")).alias("m"))
    least = least.select(F.col("key").alias("__k"), F.col("m.node").alias("__n"), F.col("m.component").alias("__c"))
    joined = labelled.join(least, (F.col("key") == F.col("__k")) & (F.col("component") != F.col("__c")))
    return joined.select(*_ordered("node", "__n")).distinct()


def _across(labelled: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """All pairs (a, b) of one key and different components that sizes, prefixes and short bitmaps allow."""
    sizes = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("sets"))
    top = sizes.groupBy("key").agg(F.max(F.struct("sets", "component")).alias("top"), F.count(F.lit(1)).alias("components")).where("components > 1")
    top = top.select(F.col("key").alias("__k"), F.col("top.component").alias("largest"))
    open_ = labelled.join(top, F.col("key") == F.col("__k")).drop("__k")
    # a bitmap folds to any smaller size
    short = [F.expr(f"aggregate(filter(bits, (v, i) -> i % {SHORT} = {j}), 0L, (u, v) -> u ^ v)").alias(f"b{j}") for j in range(SHORT)]
    small = sets.select(F.col("node").alias("__m"), (F.col("n") - F.size("tokens")).alias("alone"), *short)
    open_ = written(open_.join(small, F.col("node") == F.col("__m")).drop("__m"), f"{name}-open")
    unequal = "x.alone + y.alone + " + " + ".join(f"bit_count(x.b{j} ^ y.b{j})" for j in range(SHORT))
    may_differ = f"x.n + y.n - 2 * ceil((x.n + y.n) * {NUMERATOR} / {NUMERATOR + DENOMINATOR})"
    fits = f"least(x.n, y.n) * {DENOMINATOR} >= greatest(x.n, y.n) * {NUMERATOR}"
    # of sets that both lie outside the key's largest component a pair comes once
    once = "(y.component = y.largest or x.node < y.node)"
    # the smaller set has the key in its short prefix
    near = "case when x.n < y.n then x.short when y.n < x.n then y.short else x.short and y.short end"
    meet = f"x.key = y.key and x.component <> y.component and {once} and {near} and {fits} and {unequal} <= {may_differ}"
    outside = open_.where("component <> largest")
    return outside.alias("x").join(open_.alias("y"), F.expr(meet)).select(*_ordered("x.node", "y.node")).distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The component of near duplicates that each document lies in.

    Words are runs of bytes other than 0x20 and 0x09 to 0x0D, with A-Z in lower case; a document's set holds its
    distinct shingles of SHINGLE words, the whole sequence if it has fewer, nothing without words. Documents are
    linked if their sets' Jaccard similarity is NUMERATOR / DENOMINATOR or more. Returns a row for each row: the id,
    n_shingles, component_id (the least id that can be reached by links, its own included), text_hash (of the whole
    text), component_key (one for all of a component, whatever their ids; null without words). Documents without words
    or text are linked with nothing. A null id never is the least of a component that has another; equal texts are
    always linked. Rows of equal id are documents of their own. An empty table gives no rows. Other columns are ignored.

    Equal sets are one node, so copies in any number are compared once. A shingle stands as 64 bits of a hash; a set's
    name is 64 bits of a digest, and names that two sets would share are given to neither.
    """
    workers_can_import(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.xxhash64(text).alias("__hash"), text.alias("__text"))
    scanned, nodes, taken = _named(rows)
    documents = scanned.where("n is not null").select("__id", "__hash", "node", "n")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    n_parts = max(1, -(-total // PART_TOKENS))
    met = _met(_dealt(rows.select("__text"), taken, common_tokens(scanned), n_parts), n_parts)
    sets = written(_indexed(met, n_parts), "jaccard-sets")
    index = sets.select("node", "n", F.explode(F.arrays_zip(F.col("keys").alias("key"), F.col("short").alias("short"))).alias("e")).select("node", "n", F.col("e.key").alias("key"), F.col("e.short").alias("short"))
    several = index.groupBy("key").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select(F.col("key").alias("__k"))
    shared = written(index.join(several, F.col("key") == F.col("__k")).drop("__k"), "jaccard-keys")

    links, found = None, None
    for turn in range(ROUNDS + 1):
        labelled = _labelled(shared, found)
        pairs = _starred(labelled, turn) if turn < ROUNDS else _across(labelled, sets, "jaccard-across")
        more = _links(pairs, sets, f"jaccard-links-{turn}")
        links = more if links is None else links.unionByName(more)
        if not more.isEmpty():
            found = connected_components(links)

    placed = _labelled(nodes.select("node", F.col("first.__id").alias("least")), found)
    smallest = placed.groupBy("component").agg(F.min("least").alias("component_id")).withColumnRenamed("component", "c")
    verdict = placed.join(smallest, F.col("component") == F.col("c")).select(F.col("node").alias("v"), "component_id", F.col("component").alias("component_key"))
    return documents.join(verdict, F.col("node") == F.col("v"), "left").select(
        F.col("__id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "__id").alias("component_id"), F.col("__hash").alias("text_hash"), "component_key"
    )


#: The same rows in DuckDB.
ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) end as s from w),
t as (select doc_id, len(s) as n, unnest(s) as t from s),
l as (
  select a.doc_id as a, b.doc_id as b from t a join t b on a.t = b.t and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
m as (select a, min(b) as b from r group by a)
select s.doc_id, len(s.s)::bigint as n_shingles, least(s.doc_id, coalesce(m.b, s.doc_id)) as component_id from s left join m on s.doc_id = m.a
"""
