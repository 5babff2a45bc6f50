"""Byte-level BPE: encode by replaying merges over a whole block of distinct pieces, and decode.

A block is the set of distinct pieces of one Arrow batch. An inverted index leads from a merge's rank to the
positions of the pairs that it joins. Ranks are taken in ascending order, each joins all its positions at once, and
only the pairs of touched neighbours are looked up again. Words do not interact, so the order in which one word sees
its merges is the order in which an encoder that works word by word would apply them.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.runtime import lean, workers_can_import

#: Pieces that a worker remembers between batches; beyond it the memory is emptied.
REMEMBERED_PIECES = 250_000
#: Bytes of text whose distinct pieces are encoded together.
BLOCK_BYTES = 2 << 20

NONE = np.int32(1 << 30)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with one base64 token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class Replay:
    """Merges of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.size = size
        self.tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        found = [
            (ranks[t[:i]] * size + ranks[t[i:]], r)
            for t, r in ranks.items()
            if len(t) > 1
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        ]
        found.sort()
        self.keys = np.array([k for k, _ in found], np.int64)
        self.joined = np.array([r for _, r in found], np.int32)

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that joins each pair, or NONE."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.joined[at], NONE)

    def encode_one(self, piece: bytes) -> list[int]:
        """One piece by the definition: the leftmost pair of least rank first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], NONE), i) for i in range(len(parts) - 1))
            if rank == NONE:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces after one another, and the offsets of the pieces among them."""
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        offs = np.concatenate(([0], np.cumsum(lengths)))
        total = int(offs[-1])
        if not total:
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        sym = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        nxt = np.arange(1, total + 1)
        nxt[offs[1:][lengths > 0] - 1] = total  # total stands for "no neighbour"
        prv = np.arange(-1, total)
        prv[offs[:-1][lengths > 0]] = total
        sym = np.append(sym, np.int32(0))
        nxt = np.append(nxt, total)
        rank = np.full(total + 1, NONE, np.int32)
        here = np.flatnonzero(nxt[:total] != total)
        rank[here] = self.look_up(sym[here], sym[here + 1])
        alive = np.ones(total + 1, bool)
        odd: list[np.ndarray] = []

        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(ranks: np.ndarray, at: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            ranks, at = ranks[order], at[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, part in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts) if len(cuts) else [at]):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        here = np.flatnonzero(rank[:total] != NONE)
        if len(here):
            add(rank[here], here)
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(at) > 1:
                if len(lists) == 1:
                    at = np.unique(at)
                follows = nxt[at[:-1]] == at[1:]
                if follows.any():  # of overlapping pairs every second one is joined, from the left
                    start = np.concatenate(([True], ~follows))
                    since = np.arange(len(at)) - np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
                    at = at[since % 2 == 0]
            right = nxt[at]
            after = nxt[right]
            alive[right] = False
            rank[right] = NONE
            sym[at] = r
            nxt[at] = after
            prv[after] = at
            prv[total] = total
            before = prv[at]
            # the pair that starts here, and the pair that ends here
            new = np.where(after != total, self.look_up(sym[at], sym[after]), NONE)
            rank[at] = new
            has = before != total
            left = before[has]
            new_left = self.look_up(sym[left], sym[at[has]])
            rank[left] = new_left
            ranks = np.concatenate((new, new_left))
            at = np.concatenate((at, left))
            keep = ranks != NONE
            if keep.any():
                ranks, at = ranks[keep], at[keep]
                if (ranks < r).any():
                    odd.append(at[ranks < r])
                add(ranks, at)
        kept = alive[:total]
        ids = sym[:total][kept]
        counts = np.concatenate(([0], np.cumsum(kept)))
        out_offs = counts[offs]
        if odd:  # a merge opened a pair of lower rank: such pieces are encoded by the definition
            again = {int(i): self.encode_one(pieces[i]) for i in np.unique(np.searchsorted(offs, np.concatenate(odd), "right") - 1)}
            parts = [np.array(again[i], np.int32) if i in again else ids[out_offs[i] : out_offs[i + 1]] for i in range(n)]
            ids = np.concatenate(parts)
            out_offs = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return ids, out_offs


#: Code points below 0x250 that are letters, numbers and white space in Unicode.
LATIN_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
LATIN_NUMBERS = "0-9²³¹¼-¾"
LATIN_SPACES = "\\t-\\r \u0085\u00a0"


class Splitter:
    """Cuts texts into the matches of a pattern.

    Texts whose code points all lie below 0x250 take the standard library's faster engine, with the pattern's
    Unicode classes spelled out for that range; all others take the pattern as it is.
    """

    def __init__(self, pattern: str):
        import regex

        self.whole = regex.compile(pattern)
        plain = pattern.replace("[^\\s\\p{L}\\p{N}]", f"[^{LATIN_SPACES}{LATIN_LETTERS}{LATIN_NUMBERS}]")
        plain = plain.replace("\\p{L}", f"[{LATIN_LETTERS}]").replace("\\p{N}", f"[{LATIN_NUMBERS}]")
        plain = plain.replace("\\S", f"[^{LATIN_SPACES}]").replace("\\s", f"[{LATIN_SPACES}]")
        self.latin = None if "\\p" in plain else re.compile(plain)
        self.simple = re.compile("[\x00-ɏ]*")

    def __call__(self, text: str) -> list[str]:
        if self.latin is not None and self.simple.fullmatch(text):
            return self.latin.findall(text)
        return self.whole.findall(text)


_tools: dict[tuple[str, str], tuple] = {}


def tools(path: str, pattern: str) -> tuple:
    """Replay, splitter and remembered pieces of this worker."""
    if (path, pattern) not in _tools:
        _tools[path, pattern] = Replay(read_ranks(path)), Splitter(pattern), {}
    return _tools[path, pattern]


def encode_texts(texts: list[str], path: str, pattern: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers."""
    replay, split, known = tools(path, pattern)
    pieces = [split(t) for t in texts]
    unseen = list(set(filterfalse(known.__contains__, chain.from_iterable(pieces))))
    if len(known) + len(unseen) > REMEMBERED_PIECES:
        known.clear()
        unseen = list(set(chain.from_iterable(pieces)))
    if unseen:
        ids, offs = replay.encode([p.encode() for p in unseen])
        packed, at = ids.astype("<u4").tobytes(), (offs * 4).tolist()
        known.update((p, packed[at[i] : at[i + 1]]) for i, p in enumerate(unseen))
    get = known.__getitem__
    return [b"".join(map(get, p)) for p in pieces]


def decode_ids(packed: bytes, path: str, pattern: str) -> bytes:
    """The bytes that ids stand for."""
    replay = tools(path, pattern)[0]
    return b"".join(map(replay.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def _blocks(column: pa.Array) -> Iterator[list[str]]:
    held, size = [], 0
    for value in column:
        raw = value.as_py()
        # Spark strings may hold bytes that are not UTF-8: they are read as U+FFFD
        text = "" if raw is None else raw.decode("utf-8", "replace")
        held.append(text)
        size += len(raw or b"")
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text.

    Returns the id column, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers),
    decoded_sha256 (of the bytes decoded from the ids) and, with ``with_ids``, the ids themselves. No shuffle: rows
    are worked on where they are read. A null or empty text has no tokens and decodes to no bytes; ids may be null
    or repeat; each row gives one row; other columns are ignored. Text that is not valid UTF-8 is encoded with
    U+FFFD in place of the invalid bytes.
    """
    workers_can_import(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for block in _blocks(batch.column(1)):
                packed = encode_texts(block, path, pattern)
                columns = [
                    batch.column(0).slice(first, len(block)),
                    pa.array([len(p) // 4 for p in packed], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in packed]),
                    pa.array([hashlib.sha256(decode_ids(p, path, pattern)).hexdigest() for p in packed]),
                ]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(p, "<u4").astype(np.int64) for p in packed], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
                first += len(block)
        tools(path, pattern)[2].clear()  # workers outlive their tasks

    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>" * with_ids
    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("__text")).mapInArrow(run, schema)
