"""Exact substring dedup by suffix arrays.

Each shard's pieces become one text whose suffixes are sorted by induced sorting: suffixes are classified as smaller
or larger than their successors, the leftmost-smaller substrings are sorted (recursively, by the order of their
names), and from them all other suffixes follow in two scans. Permuted common prefixes then tell which windows begin
elsewhere, too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from loomgraph.llm import passages

#: Length of the strings that may not recur, in bytes, and of their anchors.
WINDOW = 200
GRAM = 48
#: Bytes of text for each shard.
SHARD_BYTES = 4 << 20


def _smaller(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor. The last one, of the least symbol, is."""
    n = len(t)
    step = np.sign(np.diff(t.astype(np.int64)))
    # equal symbols take the class of the next unequal pair
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    out = np.ones(n, bool)
    out[:-1] = np.append(step, 1)[nearest] > 0
    return out


def _stable(symbols: np.ndarray, size: int) -> np.ndarray:
    """A stable order of symbols below ``size``. Sixteen bits at a time, which numpy sorts in linear time."""
    order = symbols.astype(np.uint16, copy=False).argsort(kind="stable")
    for shift in range(16, max(0, size - 1).bit_length(), 16):
        order = order[(symbols >> shift).astype(np.uint16)[order].argsort(kind="stable")]
    return order


def _scan(known: np.ndarray, t: np.ndarray, take: np.ndarray, free: np.ndarray, forward: bool) -> None:
    """Fill ``known`` by induction: entries in order put their predecessors, where ``take`` allows, into the next
    free place of the predecessor's bucket.

    Entries are taken in stretches that are already filled; a stretch's predecessors keep its order within each
    bucket, so a stretch is one stable grouping by symbol.
    """
    at, n, width = 0, len(known), 256
    view = known if forward else known[::-1]
    steps = np.arange(1 << 16)
    while at < n:
        stretch = view[at : at + width]
        gaps = stretch < 0
        filled = int(gaps.argmax())
        if not gaps[filled]:
            filled = len(stretch)
        elif not filled:
            raise AssertionError("an entry was reached before it was induced")
        width = min(1 << 16, max(64, 2 * filled))
        entries = stretch[:filled]
        at += filled
        before = entries[entries > 0] - 1
        before = before[take[before]]
        if not len(before):
            continue
        symbol = t[before]
        order = _stable(symbol, len(free))
        before, symbol = before[order], symbol[order]
        cuts = (symbol[1:] != symbol[:-1]).nonzero()[0]
        first = np.zeros(len(cuts) + 1, np.int64)
        np.add(cuts, 1, out=first[1:])
        counts = np.empty(len(first), np.int64)
        np.subtract(first[1:], first[:-1], out=counts[:-1])
        counts[-1] = len(symbol) - first[-1]
        bucket = symbol[first]
        place = free[bucket]
        # the nth of a bucket goes n places on
        if forward:
            known[(place - first).repeat(counts) + steps[: len(symbol)]] = before
            free[bucket] = place + counts
        else:
            known[(place + first).repeat(counts) - steps[: len(symbol)]] = before
            free[bucket] = place - counts


def _induce(t: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray, size: int) -> np.ndarray:
    """All suffixes in order, given the leftmost-smaller ones in order."""
    n = len(t)
    larger_in = np.bincount(t[~smaller], minlength=size)
    smaller_in = np.bincount(t[smaller], minlength=size)
    leftmost_in = np.bincount(t[leftmost], minlength=size)
    # first scan: buckets hold their larger suffixes, then the leftmost-smaller ones
    ends = np.cumsum(larger_in + leftmost_in)
    known = np.full(int(ends[-1]), -1, np.int64)
    starts = ends - larger_in - leftmost_in
    symbol = t[leftmost]
    nth = np.arange(len(leftmost)) - np.repeat(np.cumsum(leftmost_in) - leftmost_in, leftmost_in)
    known[(starts + larger_in)[symbol] + nth] = leftmost
    _scan(known, t, ~smaller, starts.copy(), True)
    # second scan: larger suffixes are final, smaller ones follow in each bucket
    ends = np.cumsum(larger_in + smaller_in)
    out = np.full(n, -1, np.int64)
    larger = known[~smaller[known]]
    symbol = t[larger]
    nth = np.arange(len(larger)) - np.repeat(np.cumsum(larger_in) - larger_in, larger_in)
    out[(ends - smaller_in - larger_in)[symbol] + nth] = larger
    free = ends - 1
    out[0] = n - 1  # the last suffix follows from no other
    free = free.copy()
    free[t[n - 1]] -= 1
    _scan(out, t, smaller, free, False)
    return out


def _equal(t: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether each substring equals the one before it, symbol by symbol. No substring is empty."""
    out = lengths[1:] == lengths[:-1]
    which = np.flatnonzero(out)
    a, b, left, at = starts[which], starts[which + 1], lengths[which], 0
    while len(which):
        same = t[a + at] == t[b + at]
        out[which[~same]] = False
        at += 1
        go_on = same & (left > at)
        which, a, b, left = which[go_on], a[go_on], b[go_on], left[go_on]
    return out


def suffix_array(t: np.ndarray, size: int) -> np.ndarray:
    """Starts of the suffixes of ``t`` in order. The last symbol is 0 and occurs nowhere else; all are below ``size``."""
    n = len(t)
    if n <= 2:
        return np.arange(n)[::-1].copy()
    t = t.astype(np.uint16 if size <= 1 << 16 else np.int64, copy=False)
    smaller = _smaller(t)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(leftmost) <= 1:
        return _induce(t, smaller, leftmost, size)
    by_symbol = leftmost[_stable(t[leftmost], size)]
    sorted_ = _induce(t, smaller, by_symbol, size)
    is_leftmost = np.zeros(n, bool)
    is_leftmost[leftmost] = True
    order = sorted_[is_leftmost[sorted_]]
    # a leftmost-smaller substring reaches to the start of the next, whose symbol it includes
    ends = np.append(leftmost[1:], n - 1) + 1
    place = np.zeros(n, np.int64)
    place[leftmost] = np.arange(len(leftmost))
    rows = place[order]
    length = (ends - leftmost)[rows]
    differs = ~_equal(t, order, length)
    names = np.empty(len(leftmost), np.int64)
    names[rows] = np.concatenate(([0], np.cumsum(differs)))
    distinct = int(names.max()) + 1
    if distinct < len(leftmost):
        rows = suffix_array(names, distinct)
    return _induce(t, smaller, leftmost[rows], size)


def common_prefixes(data: np.ndarray, room: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Permuted common prefixes: for each position the suffix before it in ``order`` (-1 for the first) and how many
    bytes they share, ``room`` bytes at most.

    Where the bytes before both are equal, a prefix is the one of the position before less one; only the others are
    compared, eight bytes at a time.
    """
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    has = before >= 0
    limit = np.where(has, np.minimum(room, room[before]), 0)
    follows = np.zeros(n, bool)
    follows[1:] = has[1:] & (before[1:] > 0) & (data[:-1] == data[before[1:] - 1]) & (room[:-1] > 0) & (before[:-1] == before[1:] - 1)
    wide = np.ndarray((n,), "<u8", np.concatenate((data, np.zeros(8, np.uint8))).tobytes(), strides=(1,))
    shared = np.zeros(n, np.int64)
    left = np.flatnonzero(~follows & (limit > 0))
    while len(left):
        at = left + shared[left]
        unequal = wide[at] ^ wide[before[left] + shared[left]]
        lowest = unequal & (~unequal + np.uint64(1))
        whole = unequal == 0
        shared[left] += np.where(whole, 8, np.log2(np.where(whole, 1, lowest).astype(np.float64)).astype(np.int64) // 8)
        left = left[whole & (shared[left] < limit[left])]
    shared = np.minimum(shared, limit)
    # a chain of followers counts down from its head
    head = np.maximum.accumulate(np.where(~follows, np.arange(n), 0))
    return before, np.maximum(shared[head] - (np.arange(n) - head), 0)


def recurring(contents: list[bytes], times: np.ndarray, window: int) -> list[np.ndarray]:
    """For each piece, whether the window at each of its starts begins anywhere else in the pieces, where piece i
    stands for ``times[i]`` equal ones."""
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    data = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    t = data.astype(np.int32) + 2
    t[ends] = 1
    t = np.append(t, 0)
    order = suffix_array(t, 258)
    room = np.repeat(ends, sizes + 1) - np.arange(len(data))
    data, room = np.append(data, 0).astype(np.uint8), np.append(room, 0)
    before, shared = common_prefixes(data, room, order)
    again = shared >= window
    hit = np.flatnonzero(again)
    again[before[hit]] = True  # the suffix before shares as much
    again |= np.append(np.repeat(times > 1, sizes + 1), False)
    return [again[e - s : e - s + max(0, s - window + 1)] for s, e in zip(sizes.tolist(), ends.tolist())]


def _judge(contents: list[bytes], numbers: list[int], places: list[np.ndarray], alone: list[bool]) -> Iterator[tuple[np.ndarray, list[list[int]]]]:
    """Pieces that share an anchor with others go into the shard's suffix array. The windows of a piece whose anchor
    no other piece has can recur only where the whole piece does."""
    sort = [i for i, only in enumerate(alone) if not only]
    for where, n, only in zip(places, numbers, alone):
        if only and len(where) > 1:
            yield where, [[0, n]] * len(where)
    if not sort:
        return
    flags = recurring([contents[i] for i in sort], np.array([len(places[i]) for i in sort]), WINDOW)
    for i, flag in zip(sort, flags):
        gone = passages.intervals(flag)
        if gone:
            yield places[i], [gone] * len(places[i])


def _judge_windows(contents: list[bytes], numbers: list[int], places: list[np.ndarray], alone: list[bool]) -> Iterator[tuple[np.ndarray, list[list[int]]]]:
    """Windows that came one by one recur if their content does."""
    for where in places:
        if len(where) > 1:
            yield where, [[0, 1]] * len(where)


def _finish(text: bytes, spans: list[int]) -> tuple[int, int, int, str]:
    gone = passages.covered(spans, WINDOW, len(text))
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if spans else text
    return len(text), int(gone.sum()), len(passages.intervals(gone)) // 2, hashlib.sha256(kept).hexdigest()


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every byte covered by a WINDOW-byte string that also starts elsewhere.

    Returns a row for each row: the id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the
    remaining bytes). Strings are judged on the input, overlaps count, matches do not cross documents, and a string
    that starts twice in one document recurs. Null is the empty text. Rows equal in text remove each other
    whole, if they are long enough, whatever their ids; ids may be null. An empty table gives no rows. Other columns
    are ignored.
    """
    kind = passages.Windows(False, WINDOW, GRAM, SHARD_BYTES)
    schema = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return passages.removed_from(docs, id_col, text_col, kind, (_judge, _judge_windows), schema, _finish)


#: The same rows in DuckDB.
ORACLE = """
with h as (select doc_id, hex(coalesce(text, '')) as x, strlen(coalesce(text, '')) as n from documents),
p as (select doc_id, n, x, unnest(range(1, n + 1)) as j from h),
b as (select doc_id, j, substr(x, 2 * j - 1, 2) as byte, case when j + 199 <= n then sha256(substr(x, 2 * j - 1, 400)) end as w from p),
f as (select *, w is not null and count(*) over (partition by w) > 1 as again from b),
g as (select *, max(again) over (partition by doc_id order by j rows between 199 preceding and current row) as gone from f),
e as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by j), false) as opens from g),
a as (select doc_id, count(*) filter (gone) as r, count(*) filter (opens) as s, string_agg(byte, '' order by j) filter (not gone) as kept from e group by doc_id)
select h.doc_id, h.n::bigint as n_bytes, coalesce(r, 0)::bigint as n_removed, coalesce(s, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256
from h left join a on h.doc_id = a.doc_id
"""
