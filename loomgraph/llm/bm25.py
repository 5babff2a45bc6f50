"""Exact top-k search by BM25 with block-max pruning in sharded inverted indexes.

Documents are indexed where they are read, a bounded number of postings to a shard. Statistics are global: documents,
average length and document frequencies are counted over the whole corpus before any query runs, so scores of
different shards compare and the merged result is that of one index.

Within a shard queries are run by block-max WAND, their cursors moving for many queries and all documents at once.
Documents stand in groups that share their frequent words (those of a language, say), and a group whose bounds do not
add up to the score to beat is passed over for the query. Lists stand in order of their bounds, those with many of the
group's documents first, and the pivot is the first list at which the running sum of bounds reaches the score to beat: a
document without a posting at the pivot or after it cannot reach that score. What the lists from the pivot on bring
together is held against the bounds of the lists before it, the maxima of the document's block. A block in which that is
too little is passed over. For what is left the frequent lists are added as one product of matrices for all queries, in
single precision, and documents that can still reach the score to beat, with a margin for the rounding, get their whole
scores in double precision. The score to beat is the k-th best of the query in some of the shards, which are visited
first, or else that of the groups before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.text import chunks, lower, word_hashes, words
from loomgraph.runtime import keep_freed, lean, workers_can_import, written

#: The usual parameters of BM25.
K1 = 1.2
B = 0.75
#: Postings of a shard, and documents of a block.
SHARD_POSTINGS = 2_000_000
BLOCK_DOCS = 64
#: Groups of a shard at most, documents of one on average at least, and frequent words that tell groups apart.
MOST_GROUPS = 8
GROUP_DOCS = 750
GROUP_WORDS = 512
#: Cosine beyond which groups are one.
ALIKE = 0.5
#: A list is a column of its group's matrix if it has so many of the group's documents: one in so many, and at least so
#: many.
COLUMN_ONE_IN = 24
COLUMN_DOCS = 64
#: A group's matrix is used if so many queries at least ask the group; for fewer, the pivot may be at any list.
MATRIX_QUERIES = 8
#: Cells of queries by documents that are worked on together.
CELLS = 1 << 20
#: Terms of the queries that visit the shards together; a longer query visits them alone.
BLOCK_TERMS = 3_000_000
#: Terms whose frequencies are added up in a task before they are shuffled.
COUNTED_TERMS = 2_000_000
#: Scores are compared at so many decimal places; ties go to the smaller id.
PLACES = 6


def _terms(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row, term, count) of the distinct terms of successive rows, ordered by row and term."""
    for first, _, data, offs in chunks(column):
        low = lower(data)
        starts, ends, word_offs = words(low, offs)
        term = word_hashes(low, starts, ends)
        row = np.repeat(np.arange(len(offs) - 1), np.diff(word_offs))
        order = np.lexsort((term, row))
        row, term = row[order], term[order]
        new = np.flatnonzero(np.concatenate((np.ones(min(1, len(row)), bool), (row[1:] != row[:-1]) | (term[1:] != term[:-1]))))
        yield first, row[new].astype(np.int32), term[new], np.diff(np.append(new, len(row))).astype(np.int32)


SHARD = "ids binary, null_ids binary, lengths binary, groups binary, vocabulary binary, offsets binary, docs binary, counts binary"


def _groups(n: int, offsets: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(old numbers in their new order, bounds of the groups) of documents that are put together by the frequent words
    they share, as those of one language do. Which group a document is in changes no result."""
    n_groups = min(MOST_GROUPS, n // GROUP_DOCS)
    df = np.diff(offsets)
    lists = np.argsort(-df, kind="stable")[:GROUP_WORDS]
    lists = lists[df[lists] * 50 >= n]
    if n_groups < 2 or not len(lists):
        return np.arange(n), np.array([0, n])
    at, of = _spread(offsets[lists].astype(np.int64), offsets[lists + 1].astype(np.int64))
    has = np.zeros((n, len(lists)), np.float32)
    has[docs[at], of] = np.log((n + 1) / df[lists])[of]
    has /= np.maximum(np.linalg.norm(has, axis=1, keepdims=True), 1e-9)
    middles = has[np.linspace(0, n - 1, n_groups).astype(np.int64)]
    for _ in range(8):
        group = np.argmax(has @ middles.T, axis=1)
        middles = (group == np.arange(n_groups)[:, None]).astype(np.float32) @ has
        middles /= np.maximum(np.linalg.norm(middles, axis=1, keepdims=True), 1e-9)
    # groups that are much alike are one
    same = np.arange(n_groups)
    for a, b in zip(*np.nonzero(np.triu(middles @ middles.T, 1) > ALIKE)):
        same[same == same[b]] = same[a]
    group = same[group]
    sizes = np.bincount(group, minlength=n_groups)
    return np.argsort(group, kind="stable"), np.concatenate(([0], np.cumsum(sizes[sizes > 0])))


def build_shards(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each shard: an inverted index with some SHARD_POSTINGS postings, of documents that have any."""

    def packed(rows: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids = pa.concat_arrays([r[0] for r in rows])
        base = np.cumsum([0, *(len(r[0]) for r in rows)])
        doc = np.concatenate([r[1] + np.int32(b) for r, b in zip(rows, base)])
        term, count = np.concatenate([r[2] for r in rows]), np.concatenate([r[3] for r in rows])
        lengths = np.bincount(doc, count, len(ids)).astype("<i8")
        order = np.argsort(term, kind="stable")
        doc, term, count = doc[order], term[order], count[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(term)), bool), term[1:] != term[:-1])))
        offsets = np.append(first, len(term))
        placed, groups = _groups(len(ids), offsets, doc)
        place = np.empty(len(ids), np.int64)
        place[placed] = np.arange(len(ids))
        of = np.repeat(np.arange(len(first)), np.diff(offsets))
        order = np.argsort(of * len(ids) + place[doc], kind="stable")
        doc, count = place[doc[order]], count[order]
        parts = [
            ids.fill_null(0).to_numpy()[placed].astype("<i8"),
            ids.is_null().to_numpy(zero_copy_only=False)[placed],
            lengths[placed],
            groups.astype("<i4"),
            term[first].astype("<u8"),
            offsets.astype("<i4"),
            doc.astype("<i4"),
            count.astype("<i4"),
        ]
        return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], [c.split()[0] for c in SHARD.split(", ")])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for first, row, term, count in _terms(batch.column(1)):
                n = int(row[-1]) + 1 if len(row) else 0
                held.append((batch.column(0).slice(first, n), row, term, count))
                size += len(row)
                if size >= SHARD_POSTINGS:
                    shard = packed(held)
                    held, size = [], 0
                    yield shard
        if held:
            yield packed(held)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(run, SHARD)


def _statistics(shards: DataFrame) -> DataFrame:
    """(term, df, length): document frequencies within a task, and in rows without term the length of a shard's texts."""
    names = ["term", "df", "length"]

    def added(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        term, at = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
        df = np.bincount(at, np.concatenate([n for _, n in held]), len(term)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(term), pa.array(df), pa.nulls(len(term), pa.int64())], names)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for vocabulary, offsets, lengths in zip(*(batch.column(i) for i in range(3))):
                term = np.frombuffer(vocabulary.as_py(), "<i8")
                held.append((term, np.diff(np.frombuffer(offsets.as_py(), "<i4"))))
                size += len(term)
                total = int(np.frombuffer(lengths.as_py(), "<i8").sum())
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([total], pa.int64())], names)
                if size >= COUNTED_TERMS:
                    yield added(held)
                    held, size = [], 0
        if held:
            yield added(held)

    return shards.select("vocabulary", "offsets", "lengths").mapInArrow(run, "term bigint, df bigint, length bigint")


def _query_terms(queries: DataFrame) -> DataFrame:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, row, term, _ in _terms(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + first)), pa.array(term.view(np.int64))], ["query_id", "term"])

    return queries.mapInArrow(run, "query_id bigint, term bigint")


def _spread(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all ranges after one another, and the range of each."""
    lengths = end - first
    of = np.repeat(np.arange(len(first)), lengths)
    return np.arange(len(of)) + np.repeat(first - (np.cumsum(lengths) - lengths), lengths), of


class Shard:
    """An inverted index in memory, with the bounds of its lists in groups and in blocks of documents.

    Groups are ranges of documents. What a list has of a group is a column of the group's matrix if it is much, else a
    range of postings.
    """

    def __init__(self, row: dict[str, bytes], average: float):
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.null = np.frombuffer(row["null_ids"], bool)
        self.vocabulary = np.frombuffer(row["vocabulary"], "<u8")
        self.docs = np.frombuffer(row["docs"], "<i4")
        self.n = len(self.ids)
        #: Blocks that were passed over, postings that were read, and those of the queries' lists.
        self.skipped_blocks = self.read = self.listed = 0
        self.norm = K1 * (1 - B + B * np.frombuffer(row["lengths"], "<i8") / max(average, 1e-9))
        self.counts = np.frombuffer(row["counts"], "<i4")
        self.groups = np.frombuffer(row["groups"], "<i4").astype(np.int64)
        self.n_groups = len(self.groups) - 1
        self.by_doc: tuple[np.ndarray, ...] | None = None
        if not len(self.docs):
            return
        #: Rounded, for bounds and for picking candidates; scores are summed from ``_exact``.
        self.weight = self._exact(slice(None)).astype(np.float32)
        self.offsets = np.frombuffer(row["offsets"], "<i4")
        self.list_of = np.repeat(np.arange(len(self.vocabulary), dtype=np.int32), np.diff(self.offsets))
        # blocks do not reach across groups; an entry is what a list has in a block: its largest weight
        starts = [np.arange(a, b, BLOCK_DOCS) for a, b in zip(self.groups[:-1], self.groups[1:])]
        self.blocks = np.concatenate(([0], np.cumsum([len(x) for x in starts])))
        self.starts = np.append(np.concatenate(starts), self.n)
        block = np.repeat(np.arange(len(self.starts) - 1, dtype=np.int32), np.diff(self.starts))[self.docs]
        opens = np.ones(len(self.docs), bool)
        opens[1:] = (block[1:] != block[:-1]) | (self.list_of[1:] != self.list_of[:-1])
        opens = np.flatnonzero(opens)
        self.block, self.block_most = block[opens], np.maximum.reduceat(self.weight, opens)
        # the cells that have documents, as entries and as postings
        list_of, group = self.list_of[opens], np.repeat(np.arange(self.n_groups, dtype=np.int32), np.diff(self.blocks))[self.block]
        entry = np.ones(len(opens), bool)
        entry[1:] = (group[1:] != group[:-1]) | (list_of[1:] != list_of[:-1])
        entry = np.flatnonzero(entry)
        first, at = opens[entry], group[entry] * np.int64(len(self.vocabulary)) + list_of[entry]

        def by_group(x: np.ndarray, kind: type) -> np.ndarray:
            out = np.zeros((self.n_groups, len(self.vocabulary)), kind)
            out.ravel()[at] = x
            return out

        self.first, self.size = by_group(first, np.int32), by_group(np.diff(np.append(first, len(self.docs))), np.int32)
        self.entry, self.entry_end = by_group(entry, np.int32), by_group(np.append(entry[1:], len(opens)), np.int32)
        self.most = by_group(np.maximum.reduceat(self.block_most, entry), np.float32)
        self.column = np.full(self.size.shape, -1, np.int32)
        self.matrices, self.matrix_most = [], []
        for g in range(self.n_groups):
            n = int(self.groups[g + 1] - self.groups[g])
            lists = np.flatnonzero(self.size[g] >= max(COLUMN_DOCS, n / COLUMN_ONE_IN))
            self.column[g, lists] = np.arange(len(lists))
            first = self.first[g, lists].astype(np.int64)
            at, of = _spread(first, first + self.size[g, lists])
            matrix = np.zeros((n, len(lists)), np.float32)
            matrix[self.docs[at] - self.groups[g], of] = self.weight[at]
            self.matrices.append(matrix)
            self.matrix_most.append(np.maximum.reduceat(matrix, self.starts[self.blocks[g] : self.blocks[g + 1]] - self.groups[g], axis=0))

    def _exact(self, at) -> np.ndarray:
        count = self.counts[at]
        return count * (K1 + 1) / (count + self.norm[self.docs[at]])

    def top(self, terms: np.ndarray, idf: np.ndarray, k: int, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of all that can be among the k best and score ``least`` or more."""
        order = np.argsort(terms)
        _, docs, scores = self.tops(np.array([0, len(terms)]), np.arange(len(terms)), terms[order], idf[order], k, np.array([float(least)]))
        return docs, scores

    def tops(self, offs: np.ndarray, which: np.ndarray, terms: np.ndarray, idf: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, document, score) of what ``top`` gives for each of many queries. ``which`` has the places of the
        queries' terms among ``terms``, which are in order, ``offs`` the bounds of queries in it."""
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if not len(self.docs) or not len(which):
            return nothing
        at = np.minimum(np.searchsorted(self.vocabulary, terms), len(self.vocabulary) - 1).astype(np.int32)
        at[self.vocabulary[at] != terms] = -1
        found, few = [nothing], max(1, CELLS // int(np.diff(self.groups).max()))
        for a in range(0, len(offs) - 1, few):
            b = min(a + few, len(offs) - 1)
            asked = which[offs[a] : offs[b]]
            lists = at[asked]
            hit = np.flatnonzero(lists >= 0)
            query, docs, scores = self._batch(np.searchsorted(hit, offs[a : b + 1] - offs[a]), lists[hit], idf[asked[hit]], k, least[a:b])
            found.append((query + a, docs, scores))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _batch(self, offs: np.ndarray, lists: np.ndarray, idf: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n_queries, lengths = len(offs) - 1, np.diff(offs)
        query = np.repeat(np.arange(n_queries), lengths)
        self.listed += int((self.offsets[lists + 1] - self.offsets[lists]).sum())
        # rounded sums of n weights are off by no more than n roundings
        margin, slip = 2 * 10.0**-PLACES, (lengths + 8) * 2.0**-23
        known = least > 0
        bar = np.maximum(0.0, (least - margin) * (1 - slip) - margin)
        found = []
        for g in range(self.n_groups):
            found.append(self._group(g, query, lists, idf, k, known, bar, slip))
        query, docs = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(query, kind="stable")
        query, docs = query[order], docs[order]
        scores = self._scores(offs, lists, idf, query, docs)
        enough = scores >= np.maximum(0.0, least - margin)[query]
        bounds = np.searchsorted(query, np.arange(n_queries + 1))
        for q in np.flatnonzero(np.diff(bounds) > k).tolist():
            part = slice(bounds[q], bounds[q + 1])
            best = np.lexsort((self.ids[docs[part]], self.null[docs[part]], -scores[part]))
            enough[bounds[q] + best[k:]] = False
        return query[enough], docs[enough], scores[enough]

    def _group(self, g: int, query: np.ndarray, lists: np.ndarray, idf: np.ndarray, k: int, known: np.ndarray, bar: np.ndarray, slip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, document) of a group's documents that can reach the score to beat; ``bar`` is raised for queries
        that have none yet."""
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        start, n = int(self.groups[g]), int(self.groups[g + 1] - self.groups[g])
        bound = idf * self.most[g][lists]
        total = np.bincount(query, bound, len(bar))
        go = (total > 0) & (total >= bar)
        n_blocks = int(self.blocks[g + 1] - self.blocks[g])
        self.skipped_blocks += n_blocks * int(((total > 0) & ~go).sum())
        asked = np.flatnonzero(go)
        if not len(asked):
            return nothing
        take = np.flatnonzero(go[query] & (bound > 0))
        number = np.cumsum(go) - 1
        row, lists, idf, bound, bar_here = number[query[take]], lists[take], idf[take], bound[take], bar[asked]
        column = self.column[g][lists] if len(asked) >= MATRIX_QUERIES else np.full(len(lists), -1)
        matrix = self.matrices[g]
        wide = np.flatnonzero(column >= 0)
        factors = np.zeros((len(asked), matrix.shape[1]), np.float32)
        factors[row[wide], column[wide]] = idf[wide]
        # columns come first, then the other lists in order of their bounds: those before the pivot bring too little
        upto = np.bincount(row[wide], bound[wide], len(asked))
        rest = factors @ self.matrix_most[g].T
        narrow = np.flatnonzero(column < 0)
        early = np.flatnonzero(((2 * upto < bar_here) & known[asked])[row[narrow]])
        if len(early):
            entries = narrow[early]
            entries = entries[np.argsort(row[entries] * (2 * float(bound.max())) + bound[entries])]
            sums = np.cumsum(bound[entries])
            opens = np.searchsorted(row[entries], np.arange(len(asked)))
            before = np.append(0.0, sums)[opens]
            passed = entries[sums - before[row[entries]] + upto[row[entries]] < bar_here[row[entries]] * (1 - 1e-9)]
            at, of = _spread(self.entry[g][lists[passed]].astype(np.int64), self.entry_end[g][lists[passed]])
            rest += np.bincount(row[passed][of] * n_blocks + self.block[at] - self.blocks[g], self.block_most[at] * idf[passed][of], rest.size).reshape(rest.shape)
            keep = np.ones(len(lists), bool)
            keep[passed] = False
            narrow = narrow[keep[narrow]]
        # by list, as memory has them
        narrow = narrow[np.argsort(lists[narrow])]
        size = self.size[g][lists[narrow]]
        self.read += int(size.sum())
        ends = np.cumsum(size, dtype=np.int64)
        at = np.repeat(self.first[g][lists[narrow]] - (ends - size), size)
        at += np.arange(len(at))
        where = np.repeat(row[narrow] * n - start, size)
        where += self.docs[at]
        given = np.repeat(idf[narrow], size)
        given *= self.weight[at]
        sums = np.bincount(where, given, len(asked) * n).reshape(len(asked), n).astype(float, copy=False)
        del at, where, given
        starts = self.starts[self.blocks[g] : self.blocks[g + 1]] - start
        alive = np.maximum.reduceat(sums, starts, axis=1) + rest >= bar_here[:, None]
        # a block without any posting from the pivot on has nothing to be passed over, but is left out, too
        n_alive = int(alive.sum())
        self.skipped_blocks += alive.size - n_alive
        if not n_alive:
            return nothing
        unread = rest - factors @ self.matrix_most[g].T if len(early) else None
        if 2 * n_alive > alive.size:
            sums += factors @ matrix.T
            if unread is not None:
                sums += np.repeat(unread, np.diff(np.append(starts, n)), axis=1)
        else:
            whole, sums = sums, np.full(sums.shape, -1.0)
            for b in np.flatnonzero(alive.any(axis=0)).tolist():
                own, part = np.flatnonzero(alive[:, b]), slice(int(starts[b]), min(int(starts[b]) + BLOCK_DOCS, n))
                sums[own, part] = whole[own, part] + factors[own] @ matrix[part].T + (0.0 if unread is None else unread[own, b][:, None])
        # the k-th best so far is the score to beat of queries that came without one
        new = np.flatnonzero(~known[asked])
        if len(new) and n >= k:
            kth = np.array([np.partition(sums[q], n - k)[n - k] for q in new])
            bar[asked[new]] = bar_here[new] = np.maximum(bar_here[new], kth * (1 - 2 * slip[asked[new]]) - 4 * 10.0**-PLACES)
        own, doc = np.nonzero(sums >= np.maximum(bar_here, 1e-12)[:, None])
        return asked[own], doc + start

    def _scores(self, offs: np.ndarray, lists: np.ndarray, idf: np.ndarray, query: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Exact scores of documents for queries, which are in order, from all lists."""
        if not len(docs):
            return np.zeros(0)
        if self.by_doc is None:
            order = np.argsort(self.docs.astype(np.uint16) if self.n <= 1 << 16 else self.docs, kind="stable")
            first = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.bincount(self.docs, minlength=self.n))))
            self.by_doc = first, order.astype(np.int32), self.list_of[order], np.zeros(len(self.vocabulary))
        first, order, lists_by_doc, factor = self.by_doc
        scores = np.empty(len(docs))
        bounds = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1], [True])))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            own = slice(offs[query[a]], offs[query[a] + 1])
            factor[lists[own]] = idf[own]
            at, of = _spread(first[docs[a:b]], first[docs[a:b] + 1])
            given = factor[lists_by_doc[at]]
            has = np.flatnonzero(given)
            scores[a:b] = np.bincount(of[has], given[has] * self._exact(order[at[has]]), b - a)
            factor[lists[own]] = 0.0
        return np.round(scores, PLACES)


def _visit(shards: DataFrame, queries: pa.Table, average: float, k: int, name: str) -> DataFrame:
    """(query_id, doc_id, score): what each shard has to offer to a block of queries (query_id, terms, least), as a
    written table."""
    lists = queries["terms"].combine_chunks()
    order = queries["query_id"].to_numpy()
    offs = lists.offsets.to_numpy()
    flat = lists.values
    terms, first, which = np.unique(flat.field("term").to_numpy().view(np.uint64), return_index=True, return_inverse=True)
    shared = shards.sparkSession.sparkContext.broadcast((order, offs, which.astype(np.int32), terms, flat.field("idf").to_numpy()[first], queries["least"].to_numpy()))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        query_ids, offs, which, terms, idf, least = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard({c: batch.column(c)[i].as_buffer() for c in batch.schema.names}, average)
                query, best, scores = shard.tops(offs, which, terms, idf, k, least)
                ids = pa.array(shard.ids[best], mask=shard.null[best])
                del shard
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[query]), ids, pa.array(scores)], ["query_id", "doc_id", "score"])

    found = written(shards.mapInArrow(run, "query_id bigint, doc_id bigint, score double"), name)
    shared.destroy()
    return found


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id_col: str = "doc_id", query_text_col: str = "text") -> DataFrame:
    """The k best documents for every query.

    Terms are runs of bytes other than 0x20 and 0x09 to 0x0D, with A-Z in lower case; a query's distinct terms count
    once. Returns (query_id, rank, doc_id, score), ranks from 1, by descending score (PLACES decimal places), then by
    id, null ids last. Only documents that share a term with the query are returned, so a query may have fewer than
    k rows, and one without terms none. Null is the empty text. Repeated rows are documents of their own; a repeated
    query id stands for the union of its texts' terms. Empty tables give no rows. Other columns are ignored.

    Queries visit the shards in blocks of BLOCK_TERMS terms, which go through the driver one after the other; a block's
    results are written before the next one comes, so neither the driver nor a worker holds more than one.
    """
    workers_can_import(docs.sparkSession)
    shards = written(build_shards(docs, id_col, text_col), "bm25-shards")
    statistics = written(_statistics(shards), "bm25-statistics")
    n = docs.count()
    total = statistics.agg(F.sum("length")).first()[0] or 0
    average = total / max(n, 1)
    asked = queries.select(F.col(query_id_col).cast("long").alias("query_id"), F.col(query_text_col).cast("binary").alias("text"))
    terms = _query_terms(asked.where("query_id is not null")).distinct()
    df = statistics.where("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
    idf = F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = terms.join(df, "term").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", idf.alias("idf")))).alias("terms"))
    weighted = written(weighted, "bm25-queries")
    n_blocks = max(1, -(-(weighted.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_TERMS))
    # some shards first: the k-th best score there is one that the k best of all shards reach, too
    one_in = max(1, round(statistics.where("length is not null").count() ** 0.5))
    drawn = F.pmod(F.xxhash64("ids", "vocabulary"), F.lit(one_in)) == 0
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    found = None
    for block in range(n_blocks):
        part = weighted.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == block)
        first = _visit(shards.where(drawn), part.withColumn("least", F.lit(0.0)).toArrow(), average, k, f"bm25-first-{block}")
        kth = first.withColumn("nth", F.row_number().over(ranked)).where(F.col("nth") == k).select(F.col("query_id").alias("q"), F.col("score").alias("kth"))
        part = part.join(kth, F.col("query_id") == F.col("q"), "left").select("query_id", "terms", F.coalesce("kth", F.lit(0.0)).alias("least"))
        rest = _visit(shards.where(~drawn), part.toArrow(), average, k, f"bm25-rest-{block}")
        found = first.unionByName(rest) if found is None else found.unionByName(first).unionByName(rest)
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


#: Documents whose ids are divisible by 100 as queries against all documents, in DuckDB.
ORACLE = r"""
with w as (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) as t from documents),
tf as (select doc_id, t, count(*)::double as f from w group by doc_id, t),
dl as (select doc_id, sum(f) as dl from tf group by doc_id),
st as (select (select count(*) from documents)::double as n, (select sum(f) from tf) / (select count(*) from documents) as avgdl),
df as (select t, count(*)::double as df from tf group by t),
s as (
  select q.doc_id as query_id, d.doc_id,
    round(sum(ln(1 + (n - df.df + 0.5) / (df.df + 0.5)) * d.f * 2.2 / (d.f + 1.2 * (0.25 + 0.75 * dl.dl / avgdl))), 6) as score
  from tf q join tf d on q.t = d.t join df on df.t = q.t join dl on dl.doc_id = d.doc_id cross join st
  where q.doc_id % 100 = 0 group by q.doc_id, d.doc_id),
r as (select query_id, row_number() over (partition by query_id order by score desc, doc_id)::int as rank, doc_id, score from s)
select * from r where rank <= 10
"""
