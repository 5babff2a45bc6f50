"""Pieces of documents that may recur elsewhere, dealt out so that equal windows meet.

Two operators remove text that recurs: one judges windows of 200 bytes, one windows of 20 words. Both need every two
equal windows in one shard, and neither can afford to ship every window. A window's anchor, its part with the least
hash, depends on the window's content alone. Successive windows that share an anchor make a run, and one piece of
text holds all windows of a run. So:

1. each document's runs are found, and their anchors are counted over the whole corpus;
2. runs whose anchor occurs once hold no window that recurs: they are left out. This decides exactly, since an equal
   window elsewhere would bring the anchor a second time;
3. the pieces of all other runs are dealt into shards by anchor, equal pieces of a batch as one row with the places
   where they stand, and a shard's operator judges their windows;
4. each document gets back the spans of its windows that go.

An anchor that occurs very often, as in a passage that a third of all documents share, would bring too many different
pieces into one shard. The windows of such runs are dealt out one by one, by a digest of their whole content.

Texts are shuffled twice, compressed: to their anchors, and to the spans that go.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.text import anchor_hashes, chunks, runs, words
from loomgraph.runtime import workers_can_import

#: Anchors that occur more often are dealt out window by window.
HOT_OCCURRENCES = 1_000
#: Partitions of the shuffle that brings the pieces of a shard together at most; a task takes its shards one by one.
MOST_PARTITIONS = 20_000

#: Where a piece stands: a document's key (its id, or no_id and 0, and its text's hash) and the first unit.
PLACE = np.dtype([("no_id", "u1"), ("id", "<i8"), ("hash", "<i8"), ("start", "<i8")])


@dataclass(frozen=True)
class Windows:
    """Windows of ``length`` units, anchors of ``gram`` units, and bytes of text for each shard."""

    of_words: bool
    length: int
    gram: int
    shard_bytes: int

    def units(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Units as 64-bit words, offsets of documents among them, and each unit's first and end byte."""
        if not self.of_words:
            at = np.arange(len(data))
            return data.astype(np.uint64) + np.uint64(1), offs, at, at + 1
        starts, ends, word_offs = words(data, offs)
        return anchor_hashes(data, starts, ends), word_offs, starts, ends


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__id, __hash, __text): rows equal in id and text have one key."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(F.col(id_col).cast("long").alias("__id"), F.xxhash64(text).alias("__hash"), text.alias("__text"))


def packed(docs: DataFrame) -> DataFrame:
    """(__id, __hash, __packed): texts compressed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            done = pa.array([press.compress(t.as_buffer()) for t in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), done], ["__id", "__hash", "__packed"])

    return docs.mapInArrow(run, "__id bigint, __hash bigint, __packed binary")


def unpacked(column: pa.Array) -> list[bytes]:
    import zstandard

    open_ = zstandard.ZstdDecompressor()
    return [open_.decompress(t.as_buffer()) for t in column]


def _grouped(order_by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order that puts equal values together, and where each group begins in it."""
    order = np.argsort(order_by, kind="stable")
    sorted_ = order_by[order]
    return order, np.flatnonzero(np.concatenate((np.ones(min(1, len(order)), bool), sorted_[1:] != sorted_[:-1])))


def _anchors(docs: DataFrame, kind: Windows) -> DataFrame:
    """(anchor, times, ids, marks): the anchors of each batch once, with the keys of the documents that have them: ids
    (null: 0) and marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for first, _, data, offs in chunks(batch.column(2)):
                units, unit_offs, _, _ = kind.units(data, offs)
                doc, _, _, anchor = runs(units, unit_offs, kind.length, kind.gram)
                rows.append(doc + first)
                found.append(anchor)
            if not rows or not sum(map(len, rows)):
                continue
            row, anchor = np.concatenate(rows), np.concatenate(found)
            order, begins = _grouped(anchor)
            row, anchor = row[order], anchor[order]
            times = np.diff(np.append(begins, len(row)))
            # each document once for an anchor: rows are in order within a group
            once = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])))
            kept = row[once]
            offs = np.append(np.concatenate(([0], np.cumsum(once)))[begins], len(kept)).astype(np.int32)
            ids = batch.column(0).fill_null(0).to_numpy()[kept]
            marks = batch.column(1).to_numpy()[kept].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor[begins].view(np.int64)),
                    pa.array(times.astype(np.int64)),
                    pa.array([ids[a:b].astype("<i8").tobytes() for a, b in zip(offs[:-1], offs[1:])], pa.binary()),
                    pa.array([marks[a:b].astype("<i4").tobytes() for a, b in zip(offs[:-1], offs[1:])], pa.binary()),
                ],
                ["anchor", "times", "ids", "marks"],
            )

    return docs.mapInArrow(run, "anchor bigint, times bigint, ids binary, marks binary")


def _listed(shared: DataFrame) -> DataFrame:
    """(id, mark, anchor, hot) of every document of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i8")
            marks = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<i4")
            row = np.repeat(np.arange(batch.num_rows), [len(x) // 4 for x in batch.column(2).to_pylist()])
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(marks), batch.column(0).take(at), batch.column(3).take(at)], ["id", "mark", "anchor", "hot"])

    return shared.mapInArrow(run, "id bigint, mark int, anchor bigint, hot boolean")


def _wanted(docs: DataFrame, kind: Windows) -> DataFrame:
    """(id, mark, shared, hot): which anchors of a document occur twice or more in the corpus, and which very often.

    An anchor brings one row for each batch that has it, so no anchor is heavy here, however common."""
    anchors = _anchors(docs, kind)
    of_anchor = Window.partitionBy("anchor")
    shared = anchors.withColumn("all", F.sum("times").over(of_anchor)).where(F.col("all") > 1)
    listed = _listed(shared.select("anchor", "ids", "marks", (F.col("all") > HOT_OCCURRENCES).alias("hot")))
    return listed.groupBy("id", "mark").agg(F.collect_list(F.when(~F.col("hot"), F.col("anchor"))).alias("shared"), F.collect_list(F.when(F.col("hot"), F.col("anchor"))).alias("hot"))


PIECE = "anchor bigint, n int, whole boolean, content binary, places binary"


def _cut(docs: DataFrame, kind: Windows) -> DataFrame:
    """The pieces of the runs whose anchors are in a document's lists: each batch's distinct pieces with their places.
    Those of hot anchors come window by window: ``whole`` is true, and the content is the window's digest."""

    def cut(batch: pa.RecordBatch, texts: list[bytes], first: int, end: int, into: dict) -> None:
        data, offs = np.frombuffer(b"".join(texts[first:end]) or b"", np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts[first:end]])))
        shared = batch.column(3).slice(first, end - first).flatten().to_numpy(zero_copy_only=False)
        hot = batch.column(4).slice(first, end - first).flatten().to_numpy(zero_copy_only=False)
        units, unit_offs, lo, hi = kind.units(data, offs)
        doc, start, n, anchor = runs(units, unit_offs, kind.length, kind.gram)
        anchor = anchor.view(np.int64)
        each = np.isin(anchor, hot)
        keep = each | np.isin(anchor, shared)
        doc, start, n, anchor, each = doc[keep], start[keep], n[keep], anchor[keep], each[keep]
        if each.any():
            times = np.where(each, n, 1)
            step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            doc, anchor, each = np.repeat(doc, times), np.repeat(anchor, times), np.repeat(each, times)
            n = np.where(each, 1, np.repeat(n, times))
            start = np.repeat(start, times) + step
        raw = data.tobytes()
        no_id = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        ids, hashes = batch.column(0).fill_null(0).to_numpy(), batch.column(1).to_numpy()
        places = np.zeros(len(doc), PLACE)
        places["no_id"], places["id"], places["hash"], places["start"] = no_id[doc + first], ids[doc + first], hashes[doc + first], start - unit_offs[doc]
        packed_places = places.tobytes()
        size = PLACE.itemsize
        stops = start + n + kind.length - 1
        if kind.of_words:
            begins, ends = lo.tolist(), hi.tolist()
            contents = (b" ".join([raw[begins[i] : ends[i]] for i in range(s, e)]) for s, e in zip(start.tolist(), stops.tolist()))
        else:
            contents = (raw[s:e] for s, e in zip(start.tolist(), stops.tolist()))
        for i, (content, a, m, single) in enumerate(zip(contents, anchor.tolist(), n.tolist(), each.tolist())):
            if single:
                content = hashlib.blake2b(content, digest_size=20).digest()
                a = int.from_bytes(content[:8], "little", signed=True)
            key = (content, a, m, single)
            place = packed_places[i * size : (i + 1) * size]
            if key in into:
                into[key].append(place)
            else:
                into[key] = [place]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into: dict[tuple, list[bytes]] = {}
        size = 0
        for batch in batches:
            texts = unpacked(batch.column(2))
            first = 0
            while first < len(texts):
                end, length = first, 0
                while end < len(texts) and (length == 0 or length + len(texts[end]) <= 1 << 18):
                    length += len(texts[end])
                    end += 1
                cut(batch, texts, first, end, into)
                size += length
                first = end
                if size >= 8 << 20:
                    yield _pieces(into)
                    into, size = {}, 0
        if into:
            yield _pieces(into)

    return docs.mapInArrow(run, PIECE)


def _pieces(into: dict[tuple, list[bytes]]) -> pa.RecordBatch:
    contents, anchors, n, whole = (list(c) for c in zip(*into)) if into else ([], [], [], [])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(anchors, pa.int64()),
            pa.array(n, pa.int32()),
            pa.array(whole, pa.bool_()),
            pa.array(contents, pa.binary()),
            pa.array([b"".join(p) for p in into.values()], pa.binary()),
        ],
        [c.split()[0] for c in PIECE.split(", ")],
    )


#: What a judge is given: contents and numbers of windows of distinct pieces, the places of each, and whether no other
#: piece has its anchor. It returns, for each piece, its places again and for each place the flat spans of window
#: starts within the piece that go.
Judge = Callable[[list[bytes], list[int], list[np.ndarray], list[bool]], Iterator[tuple[np.ndarray, list[list[int]]]]]

SPANS = "no_id boolean, id bigint, hash bigint, spans array<bigint>"


def _judged(found: DataFrame, judge: Judge, judge_windows: Judge, n_shards: int) -> DataFrame:
    """SPANS of window starts that go, by document: one row or more for each that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: tuple[dict, dict] = ({}, {})
        pieces_of: Counter[int] = Counter()
        now = None
        for batch in batches:
            for anchor, n, whole, content, places, number in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if number != now:
                    yield from decided(merged, pieces_of)
                    merged, pieces_of, now = ({}, {}), Counter(), number
                if content not in merged[whole]:
                    merged[whole][content] = [n, [], anchor]
                    pieces_of[anchor] += not whole
                merged[whole][content][1].append(places)
        yield from decided(merged, pieces_of)

    def decided(merged: tuple[dict, dict], pieces_of: Counter[int]) -> Iterator[pa.RecordBatch]:
        spans: dict[tuple, list[int]] = {}
        for whole, decide in ((False, judge), (True, judge_windows)):
            held = merged[whole]
            numbers = [n for n, _, _ in held.values()]
            places = [np.frombuffer(b"".join(p), PLACE) for _, p, _ in held.values()]
            alone = [pieces_of[a] == 1 for _, _, a in held.values()]
            for where, gone in decide(list(held), numbers, places, alone):
                for (no_id, id_, hash_, start), own in zip(where.tolist(), gone):
                    if own:
                        spans.setdefault((no_id, id_, hash_), []).extend([start + x for x in own])
        keys = list(spans)
        for first in range(0, len(keys), 10_000):
            part = keys[first : first + 10_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([bool(k[0]) for k in part], pa.bool_()),
                    pa.array([k[1] for k in part], pa.int64()),
                    pa.array([k[2] for k in part], pa.int64()),
                    pa.array([spans[k] for k in part], pa.list_(pa.int64())),
                ],
                ["no_id", "id", "hash", "spans"],
            )

    if n_shards <= MOST_PARTITIONS:  # a partition is a shard
        return found.withColumn("shard", F.lit(0).cast("long")).repartition(n_shards, "anchor").mapInArrow(run, SPANS)
    numbered = found.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(n_shards)))
    return numbered.repartition(MOST_PARTITIONS, "shard").sortWithinPartitions("shard").mapInArrow(run, SPANS)


def removed_from(docs: DataFrame, id_col: str, text_col: str, kind: Windows, judges: tuple[Judge, Judge], schema: str, finish: Callable[[bytes, list[int]], tuple]) -> DataFrame:
    """Find the windows that go and apply ``finish`` to each text and the flat spans of their starts.

    Returns a row (id column, schema) for each row of ``docs``."""
    workers_can_import(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    # a mark tells apart documents of one id; where it fails to, one gets the other's anchors besides its own
    low = F.expr("cast(shiftleft(__hash, 32) as bigint) >> 32").cast("int")
    key = {"id": F.coalesce("__id", F.lit(0).cast("long")), "mark": F.coalesce(low, F.lit(0))}
    texts = packed(rows).withColumns(key)
    with_anchors = texts.join(_wanted(rows, kind), ["id", "mark"]).select("__id", "__hash", "__packed", "shared", "hot")
    spans = _judged(_cut(with_anchors, kind), *judges, max(1, -(-size // kind.shard_bytes)))
    by_key = spans.withColumn("mark", F.expr("cast(shiftleft(hash, 32) as bigint) >> 32").cast("int")).groupBy("id", "mark")
    found = by_key.agg(F.collect_list(F.struct("no_id", "hash", "spans")).alias("spans"))
    ready = texts.join(found, ["id", "mark"], "left").select("__id", "__hash", "__packed", "spans")
    names = [id_col, *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for id_, hash_, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), unpacked(batch.column(2)), batch.column(3)):
                own = [s["spans"] for s in found.as_py() or [] if s["hash"] == hash_ and s["no_id"] == (id_ is None)]
                out.append(finish(text, [x for spans in own for x in spans]))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in zip(*out))], names)

    return ready.mapInArrow(run, f"`{id_col}` bigint, {schema}")


def intervals(flags: np.ndarray) -> list[int]:
    """Flat [start, end, ...] of the runs of true values."""
    return np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))).tolist()


def covered(spans: list[int], length: int, n: int) -> np.ndarray:
    """Which of n units lie in a window of ``length`` units whose start lies in one of the flat spans."""
    change = np.zeros(n + 1, np.int64)
    if spans:
        at = np.asarray(spans, np.int64)
        np.add.at(change, at[0::2], 1)
        np.add.at(change, np.minimum(at[1::2] - 1 + length, n), -1)
    return np.cumsum(change[:-1]) > 0
