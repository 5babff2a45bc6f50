"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a document is the logistic function of a linear term and all pairwise interactions of its features,
each pair weighted by the inner product of two short vectors. The sum over pairs takes linear time, as half of
(sum of v x) squared less the sum of (v x) squared, for each component of the vectors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.text import chunks, prefix_sums, span_hash, unused, words
from loomgraph.runtime import lean, workers_can_import

#: Buckets of hashed words, and components of a feature's vector.
WORD_BITS = 16
FACTORS = 8
#: Statistics are standardised and clipped, and also put into so many bins of equal counts in the sample.
BINS = 8
#: The classifier learns from at most so many labelled rows: those whose ids have the least hashes.
SAMPLE_ROWS = 12_000
EPOCHS = 8
BATCH = 256
#: A document is accepted from this score on.
ACCEPT = 0.7

STATISTICS = (
    "log_chars", "log_bytes", "log_words", "bytes_per_word", "upper", "digit", "punctuation", "newline", "not_ascii",
    "distinct_words", "commonest_word", "repeated_lines", "bytes_per_line", "end_punctuation",
)
N_WORDS = 1 << WORD_BITS
N_FEATURES = N_WORDS + len(STATISTICS) * (1 + BINS)

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_HIGH = np.arange(256) >= 0xC0


def _per_doc(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(mask)))
    return (sums[offs[1:]] - sums[offs[:-1]]).astype(np.float64)


def _distinct(doc: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """How many distinct keys each document has."""
    if not len(doc):
        return np.zeros(n)
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])))
    return np.bincount(d[new], minlength=n).astype(np.float64)


def raw_features(data: np.ndarray, offs: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, their values, offsets of documents among them, and statistics (documents x STATISTICS)."""
    n = len(offs) - 1
    sums = prefix_sums(data.astype(np.uint64) + np.uint64(1))
    starts, ends, word_offs = words(data, offs)
    doc = np.repeat(np.arange(n), np.diff(word_offs))
    bucket = (span_hash(sums, starts, ends) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    key, count = np.unique((doc << WORD_BITS) | bucket, return_counts=True)
    of, at = key >> WORD_BITS, key & (N_WORDS - 1)
    value = count / np.sqrt(np.maximum(np.bincount(of, count.astype(np.float64) ** 2, n), 1e-9))[of]
    feature_offs = np.searchsorted(of, np.arange(n + 1))

    size, n_words = np.diff(offs).astype(np.float64), np.diff(word_offs).astype(np.float64)
    cuts = np.flatnonzero(data == 10)
    line_starts = np.union1d(offs[:-1][size > 0], cuts + 1)
    line_starts = line_starts[line_starts < len(data)]
    line_doc = np.searchsorted(offs, line_starts, "right") - 1
    line_ends = np.minimum(np.append(line_starts[1:], len(data)), offs[line_doc + 1])
    lines = np.bincount(line_doc, minlength=n).astype(np.float64) if len(line_doc) else np.zeros(n)
    at_least = np.maximum
    last = np.concatenate((data[ends - 1], np.zeros(1, np.uint8)))[: len(ends)]
    commonest = np.zeros(n)
    np.maximum.at(commonest, of, count.astype(np.float64))
    ends_in_mark = np.bincount(doc, _PUNCT[last], n) if len(doc) else np.zeros(n)
    stats = np.stack(
        [
            np.log1p(at_least(chars, 0)),
            np.log1p(size),
            np.log1p(n_words),
            size / at_least(n_words, 1),
            _per_doc(_UPPER[data], offs) / at_least(size, 1),
            _per_doc(_DIGIT[data], offs) / at_least(size, 1),
            _per_doc(_PUNCT[data], offs) / at_least(size, 1),
            _per_doc(data == 10, offs) / at_least(size, 1),
            _per_doc(_HIGH[data], offs) / at_least(size, 1),
            _distinct(doc, bucket, n) / at_least(np.sqrt(n_words), 1),
            commonest / at_least(n_words, 1),
            1 - _distinct(line_doc, span_hash(sums, line_starts, line_ends), n) / at_least(lines, 1),
            np.log1p(size / at_least(lines, 1)),
            ends_in_mark / at_least(n_words, 1),
        ],
        axis=1,
    )
    return at, value, feature_offs, stats


@dataclass
class Scales:
    mean: np.ndarray
    spread: np.ndarray
    edges: np.ndarray  # statistics x (BINS - 1)

    @classmethod
    def fit(cls, stats: np.ndarray) -> Scales:
        if not len(stats):
            stats = np.zeros((1, len(STATISTICS)))
        edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
        return cls(stats.mean(0), np.maximum(stats.std(0), 1e-6), edges)

    def features(self, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices and values, documents x (2 * STATISTICS)."""
        n, m = stats.shape
        numeric = np.clip((stats - self.mean) / self.spread, -3, 3) / 3
        bins = np.stack([np.searchsorted(self.edges[j], stats[:, j], "right") for j in range(m)], axis=1)
        own = N_WORDS + np.arange(m)
        index = np.concatenate((np.broadcast_to(own, (n, m)), N_WORDS + m + np.arange(m) * BINS + bins), axis=1)
        return index, np.concatenate((numeric, np.full((n, m), 0.5)), axis=1)


def assembled(at: np.ndarray, value: np.ndarray, offs: np.ndarray, index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word features followed by statistics, document by document."""
    n, m = index.shape
    lengths = np.diff(offs)
    out_offs = np.concatenate(([0], np.cumsum(lengths + m)))
    out_index, out_value = np.empty(out_offs[-1], np.int32), np.empty(out_offs[-1], np.float32)
    place = np.arange(len(at)) + np.repeat(np.arange(n) * m, lengths)
    out_index[place], out_value[place] = at, value
    place = (out_offs[1:, None] - m + np.arange(m)).ravel()
    out_index[place], out_value[place] = index.ravel(), values.ravel()
    return out_index, out_value, out_offs


class Machine:
    """The factorisation machine. Documents are (indices, values, offsets) and have one feature at least."""

    def __init__(self, seed: int = 7):
        self.bias = 0.0
        self.linear = np.zeros(N_FEATURES, np.float32)
        self.vectors = np.random.default_rng(seed).normal(0, 0.02, (N_FEATURES, FACTORS)).astype(np.float32)

    def _parts(self, index: np.ndarray, value: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vx = self.vectors[index] * value[:, None].astype(np.float32)
        s = np.add.reduceat(vx, offs[:-1], axis=0)
        q = np.add.reduceat(vx * vx, offs[:-1], axis=0)
        z = self.bias + np.add.reduceat(self.linear[index] * value, offs[:-1]) + 0.5 * (s * s - q).sum(1)
        return z, s, vx

    def scores(self, index: np.ndarray, value: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._parts(index, value, offs)[0], -30, 30))).astype(np.float64)

    def learn(self, index: np.ndarray, value: np.ndarray, offs: np.ndarray, label: np.ndarray, rate: float = 0.1, decay: float = 1e-6) -> None:
        rng = np.random.default_rng(11)
        share = np.clip(label.mean(), 0.01, 0.99)
        self.bias = float(np.log(share / (1 - share)))
        seen_w, seen_v, seen_b = np.full(N_FEATURES, 1e-2), np.full((N_FEATURES, FACTORS), 1e-2), 1.0
        lengths = np.diff(offs)
        for _ in range(EPOCHS):
            order = rng.permutation(len(label))
            for first in range(0, len(order), BATCH):
                rows = order[first : first + BATCH]
                own = lengths[rows]
                o = np.concatenate(([0], np.cumsum(own)))
                take = np.repeat(offs[rows] - o[:-1], own) + np.arange(o[-1])
                i, x = index[take], value[take]
                z, s, vx = self._parts(i, x, o)
                g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[rows]
                gx = np.repeat(g, own) * x / len(rows)
                slope = gx[:, None] * (np.repeat(s, own, axis=0) - vx)
                by = np.argsort(i, kind="stable")
                cuts = np.flatnonzero(np.concatenate(([True], i[by][1:] != i[by][:-1])))
                hit = i[by][cuts]
                gw = np.add.reduceat(gx[by], cuts) + decay * self.linear[hit]
                gv = np.add.reduceat(slope[by], cuts, axis=0) + decay * self.vectors[hit]
                seen_w[hit] += gw**2
                seen_v[hit] += gv**2
                seen_b += float(g.mean()) ** 2
                self.linear[hit] -= (rate * gw / np.sqrt(seen_w[hit])).astype(np.float32)
                self.vectors[hit] -= (rate * gv / np.sqrt(seen_v[hit])).astype(np.float32)
                self.bias -= rate * float(g.mean()) / np.sqrt(seen_b)


@dataclass
class Model:
    machine: Machine | None  # None: nothing to learn from
    scales: Scales

    def score(self, column: pa.Array, chars: np.ndarray) -> np.ndarray:
        out = []
        for first, end, data, offs in chunks(column):
            if self.machine is None:
                out.append(np.ones(end - first))
                continue
            at, value, feature_offs, stats = raw_features(data, offs, chars[first:end])
            out.append(self.machine.scores(*assembled(at, value, feature_offs, *self.scales.features(stats))))
        return np.concatenate(out) if out else np.zeros(0)


def held_out(id_col: Column) -> Column:
    """Whether a row's label must not be learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _inputs(docs: DataFrame, id_col: str, text_col: str, chars_col: str) -> DataFrame:
    chars = F.col(chars_col).cast("double") if chars_col in docs.columns else F.lit(None).cast("double")
    text = F.col(text_col).cast("binary")
    return docs.select(F.col(id_col).alias("__id"), text.alias("__text"), F.coalesce(chars, F.lit(0.0)).alias("__chars"))


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", chars_col: str = "n_chars") -> Model:
    """A model learned from at most SAMPLE_ROWS labelled rows that aren't held out.

    A document with several labels counts as good if half of them are. Null ids and labels are ignored. Of several
    documents with one id the one whose text has the least hash is learned from. Null and empty texts are learned from
    by their statistics. Without labelled rows, or documents, there is nothing to go by and every document scores 1.
    Other columns are ignored.
    """
    workers_can_import(docs.sparkSession)
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("__lid"))
        .agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("double").alias("__label"))
        .orderBy(F.md5(F.col("__lid").cast("string")), "__lid")
        .limit(SAMPLE_ROWS)
    )
    sample = _inputs(docs, id_col, text_col, chars_col).join(F.broadcast(known), F.col("__id") == F.col("__lid"))
    one = F.min(F.struct(F.xxhash64("__text").alias("h"), "__text", "__chars", "__label")).alias("one")
    sample = sample.groupBy("__id").agg(one).select("__id", "one.__text", "one.__chars", "one.__label")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars = batch.column(2).to_numpy(zero_copy_only=False)
            for first, end, data, offs in chunks(batch.column(1)):
                at, value, o, stats = raw_features(data, offs, chars[first:end])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, end - first),
                        batch.column(3).slice(first, end - first),
                        pa.array([at[a:b].astype("<i4").tobytes() for a, b in zip(o[:-1], o[1:])], pa.binary()),
                        pa.array([value[a:b].astype("<f4").tobytes() for a, b in zip(o[:-1], o[1:])], pa.binary()),
                        pa.array([s.astype("<f8").tobytes() for s in stats], pa.binary()),
                    ],
                    ["id", "label", "at", "value", "stats"],
                )

    kind = sample.schema["__id"].dataType.simpleString()
    rows = sample.mapInArrow(run, f"id {kind}, label double, at binary, value binary, stats binary").toArrow()
    if not rows.num_rows:
        return Model(None, Scales.fit(np.zeros((0, len(STATISTICS)))))
    ids = rows["id"].to_pylist()
    rows = rows.take(sorted(range(len(ids)), key=lambda i: (zlib.crc32(str(ids[i]).encode()), ids[i])))

    def numbers(name: str, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(x.as_buffer() for x in rows[name].combine_chunks()), kind)

    stats = numbers("stats", "<f8").reshape(-1, len(STATISTICS))
    scales = Scales.fit(stats)
    lengths = np.array([len(x.as_buffer()) // 4 for x in rows["at"].combine_chunks()])
    label = rows["label"].to_numpy()
    features = assembled(numbers("at", "<i4"), numbers("value", "<f4"), np.concatenate(([0], np.cumsum(lengths))), *scales.features(stats))
    del rows
    machine = Machine()
    machine.learn(*features, label)
    return Model(machine, scales)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """Score every whole text.

    Returns the id, held_out, score (0 to 1, higher: better) and predicted (1 from ACCEPT on). Null and empty texts
    are scored by their statistics alone; a null id isn't held out; each row gives one row. Nothing but the text and
    its number of characters goes into a score. No shuffle: the model, of fixed size, goes to every worker.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    workers_can_import(docs.sparkSession)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.score(batch.column(1), batch.column(2).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["__id", "score"])

    inputs = _inputs(docs, id_col, text_col, chars_col)
    scored = inputs.mapInArrow(run, f"__id {inputs.schema['__id'].dataType.simpleString()}, score double")
    return scored.select(
        F.col("__id").alias(id_col), held_out(F.col("__id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, model: Model, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, unchanged.

    Each row is judged by its text alone, so equal texts of equal n_chars share a verdict; null and empty texts are judged
    by their statistics. An empty table gives no rows. Other columns are carried along, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    workers_can_import(docs.sparkSession)
    own = docs.schema
    chars = F.col(chars_col).cast("double") if chars_col in docs.columns else F.lit(None).cast("double")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns
            found = shared.value.score(batch.column(n - 2), batch.column(n - 1).to_numpy(zero_copy_only=False))
            yield batch.select(list(range(n - 2))).filter(pa.array(found >= ACCEPT))

    text, size = (unused(docs.columns, c) for c in ("__quality_text", "__quality_chars"))
    plus = docs.select("*", F.col(text_col).cast("binary").alias(text), F.coalesce(chars, F.lit(0.0)).alias(size))
    return plus.mapInArrow(run, own)
