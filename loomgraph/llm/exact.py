"""Exact dedup by minimal perfect hashes over the digests of what is already known.

Known digests are dealt into shards by their first bytes. Each shard's distinct digests get a minimal perfect hash:
levels of bit arrays in which a digest owns the bit that no other digest of its level hits; its slot is the number of
bits set before. A slot holds the whole digest and the winner's locator, so a lookup is checked byte by byte and a
digest that is not known cannot pass for one that is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.text import mix
from loomgraph.runtime import workers_can_import, written

#: Digests that a shard is meant to hold.
SHARD_DIGESTS = 20_000
#: Bits for each digest that a level still has to place.
SPACE = 2.0

_NONE = np.iinfo(np.int64).min


def _halves(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = digests.view("<u8").reshape(len(digests), 4)
    return words[:, 0].copy(), words[:, 1].copy()


def _hash(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((level * 0x9E3779B97F4A7C15 + 1) & ((1 << 64) - 1))
    return (mix(a ^ mix(b + seed)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct 32-byte digests, given as an (n, 32) array of bytes."""

    def __init__(self, digests: np.ndarray):
        self.levels: list[np.ndarray] = []
        left = np.arange(len(digests))
        a, b = _halves(digests) if len(digests) else (np.zeros(0, np.uint64),) * 2
        while len(left):
            if len(self.levels) > 200:
                raise ValueError("digests are not distinct")
            size = max(8, int(SPACE * len(left)))
            at = _hash(a[left], b[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append(alone)
            left = left[~alone[at]]
        self._index()

    def _index(self) -> None:
        sizes = [int(level.sum()) for level in self.levels]
        self.first = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.rank = [np.cumsum(level) - 1 for level in self.levels]

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest; of one that the hash wasn't built over, some slot or -1."""
        out = np.full(len(digests), -1, np.int64)
        if not len(digests):
            return out
        a, b = _halves(digests)
        left = np.arange(len(digests))
        for i, level in enumerate(self.levels):
            at = _hash(a[left], b[left], i, len(level))
            hit = level[at]
            out[left[hit]] = self.first[i] + self.rank[i][at[hit]]
            left = left[~hit]
            if not len(left):
                break
        return out

    def dump(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<i8")
        return sizes.tobytes() + b"".join(np.packbits(level).tobytes() for level in self.levels)

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        new = cls.__new__(cls)
        n = int(np.frombuffer(data, "<i8", 1)[0])
        sizes = np.frombuffer(data, "<i8", n, 8)
        new.levels, at = [], 8 * (n + 1)
        for size in sizes.tolist():
            packed = np.frombuffer(data, np.uint8, -(-size // 8), at)
            new.levels.append(np.unpackbits(packed, count=size).astype(bool))
            at += -(-size // 8)
        new._index()
        return new


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(_NONE).to_numpy().astype(np.int64)


def _locators(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=values == _NONE)


def build_index(known: DataFrame, n_shards: int) -> DataFrame:
    """(shard, n, hash, digests, winners, counts): the index of known digests, a row for each shard that has any.

    ``known`` has a row (digest, winner, n) for each distinct digest.
    """
    workers_can_import(known.sparkSession)

    def build(key: tuple, table: pa.Table) -> pa.Table:
        digests = _matrix(table["digest"])
        hashed = PerfectHash(digests)
        order = np.empty(len(digests), np.int64)
        order[hashed.slots(digests)] = np.arange(len(digests))
        return pa.table(
            {
                "shard": pa.array([key[0].as_py()], pa.int64()),
                "n": pa.array([len(digests)], pa.int64()),
                "hash": pa.array([hashed.dump()], pa.binary()),
                "digests": pa.array([digests[order].tobytes()], pa.binary()),
                "winners": pa.array([_numbers(table["winner"])[order].astype("<i8").tobytes()], pa.binary()),
                "counts": pa.array([_numbers(table["n"])[order].astype("<i8").tobytes()], pa.binary()),
            }
        )

    sharded = known.select(_shard(n_shards).alias("shard"), "digest", "winner", "n")
    return sharded.groupBy("shard").applyInArrow(build, "shard bigint, n bigint, hash binary, digests binary, winners binary, counts binary")


def _shard(n_shards: int) -> Column:
    return F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long") % n_shards


def look_up(index: DataFrame, batch: DataFrame, n_shards: int) -> DataFrame:
    """(digest, winner, n) of every digest in the index or the batch.

    ``batch`` has a row (digest, winner, n) for each distinct digest of the new rows. A member takes the known winner;
    digests that aren't members keep their own. Counts are added up.
    """

    def find(key: tuple, index: pa.Table, batch: pa.Table) -> pa.Table:
        if not index.num_rows:
            return batch.select(["digest", "winner", "n"])
        row = {c: index[c][0].as_py() for c in ("hash", "digests", "winners", "counts")}
        slots_digest = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        winners, counts = np.frombuffer(row["winners"], "<i8"), np.frombuffer(row["counts"], "<i8").copy()
        rest = []
        if batch.num_rows:
            asked, own_n = _matrix(batch["digest"]), _numbers(batch["n"])
            slots = PerfectHash.load(row["hash"]).slots(asked)
            member = slots >= 0
            member[member] = (slots_digest[slots[member]] == asked[member]).all(axis=1)
            counts[slots[member]] += own_n[member]
            rest = [batch.filter(pa.array(~member)).select(["digest", "winner", "n"]).combine_chunks()]
        known = pa.table(
            {
                "digest": pa.array([slots_digest[i].tobytes() for i in range(len(winners))], pa.binary()),
                "winner": _locators(winners.astype(np.int64)),
                "n": pa.array(counts.astype(np.int64)),
            }
        )
        return pa.concat_tables([known, *rest])

    sharded = batch.select(_shard(n_shards).alias("shard"), "digest", "winner", "n")
    return index.groupBy("shard").cogroup(sharded.groupBy("shard")).applyInArrow(find, "digest binary, winner bigint, n bigint")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The verdict on every row: which row of its group of equal texts stays.

    Returns a row for each row: the id, keep_id (the largest id of the group), group_size, kept, text_sha256. Null
    counts as the empty text. A null id is smaller than every other; rows equal in id and text are one row repeated
    and share its verdict. An empty table gives no rows. Other columns are ignored.

    The rows of the upper half of ids are what is known: since the largest id wins, their winners are final. The
    other rows are looked up; those not known form groups among themselves. Both sides are aggregated by digest
    before they are dealt out, so a group of any size reaches a shard as one row. Texts are read once and not
    shuffled.
    """
    rows = written(
        docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")), 256)).alias("digest")),
        "digests",
        few_files=True,
    )
    middle, count = rows.agg(F.percentile_approx("id", 0.5, 1000), F.count(F.lit(1))).first()
    middle = 0 if middle is None else middle
    upper = F.col("id") >= middle
    groups = [F.max("id").alias("winner"), F.count(F.lit(1)).alias("n")]
    n_shards = max(1, -(-count // SHARD_DIGESTS))
    index = written(build_index(rows.where(upper).groupBy("digest").agg(*groups), n_shards), "perfect-hash")
    batch = rows.where(~F.coalesce(upper, F.lit(False))).groupBy("digest").agg(*groups)
    verdicts = look_up(index, batch, n_shards).withColumnRenamed("digest", "d")
    return rows.join(verdicts, F.col("digest") == F.col("d")).select(
        F.col("id").alias(id_col),
        F.col("winner").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("winner")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


#: The same rows in DuckDB.
ORACLE = """
with d as (select doc_id, sha256(coalesce(text, '')) as h from documents),
g as (select h, max(doc_id) as keep_id, count(*)::bigint as group_size from d group by h)
select d.doc_id, g.keep_id, g.group_size, d.doc_id is not distinct from g.keep_id as kept, d.h as text_sha256
from d join g on d.h = g.h
"""
