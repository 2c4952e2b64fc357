"""Conflict-constrained best-fit packing of documents into bins of a token budget.

Bins are ordered by what is left in them and carry bitmaps of their sources and duplicate clusters. A document
goes to the fullest bin that has room and shares neither: the search starts at the smallest residual that fits and
goes on to the next one until a compatible bin is found. Documents are dealt into shards of bounded size by hash,
each shard is packed by one task.
"""
from __future__ import annotations

from bisect import insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..operators.store import stored


class Bins:
    """Open bins by residual. ``mask`` has bit r set while a bin with residual r is open, so that the successor
    of a residual is one shift away."""

    def __init__(self, capacity: int):
        self.capacity, self.n, self.mask = capacity, 0, 0
        self.at: dict[int, list[int]] = {}
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def put(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and start within it."""
        r, m = length, self.mask >> length
        while m:
            step = (m & -m).bit_length() - 1
            r, m = r + step, m >> step
            for b in self.at[r]:
                if not (self.sources[b] & source or self.clusters[b] & cluster):
                    self._move(b, r, r - length)
                    self.sources[b] |= source
                    self.clusters[b] |= cluster
                    return b, self.capacity - r
            r, m = r + 1, m >> 1
        b, self.n = self.n, self.n + 1
        self.sources.append(source)
        self.clusters.append(cluster)
        self._move(b, 0, self.capacity - length)
        return b, 0

    def _move(self, b: int, old: int, new: int) -> None:
        if old:
            self.at[old].remove(b)
            if not self.at[old]:
                self.mask &= ~(1 << old)
        if new:
            insort(self.at.setdefault(new, []), b)
            self.mask |= 1 << new


def conflict_bits(values: pa.Array) -> list[int]:
    """A bit for each value found at least twice; none for nulls and for values that meet no equal."""
    d = pc.dictionary_encode(values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values)
    codes = pc.fill_null(d.indices, -1).to_numpy(zero_copy_only=False)
    n = np.bincount(codes[codes >= 0], minlength=len(d.dictionary))
    bit = np.cumsum(n > 1) - 1
    return [1 << int(bit[c]) if c >= 0 and n[c] > 1 else 0 for c in codes]


def pack_shard(t: pa.Table, capacity: int) -> pa.Table:
    t = t.take(pc.sort_indices(t, sort_keys=[("length", "descending"), ("id", "ascending"), ("source", "ascending"), ("cluster", "ascending")]))
    length = t["length"].to_pylist()
    src, dup = conflict_bits(t["source"]), conflict_bits(t["cluster"])
    # pieces as long as a bin go to bins of their own
    whole = [n // capacity for n in length]
    bins, base = Bins(capacity), sum(whole)
    row, piece, no, start, size = [], [], [], [], []
    used = 0
    rest = []
    for i, n in enumerate(length):
        for k in range(whole[i]):
            row.append(i), piece.append(k), no.append(used), start.append(0), size.append(capacity)
            used += 1
        if n % capacity:
            rest.append((n % capacity, i))
    rest.sort(key=lambda x: -x[0])  # decreasing; equal ones stay in order of id
    for n, i in rest:
        b, s = bins.put(n, src[i], dup[i])
        row.append(i), piece.append(whole[i]), no.append(base + b), start.append(s), size.append(n)
    shard = t["shard"][0].as_py() if t.num_rows else 0
    ids = t["id"].take(pa.array(row, pa.int64()))
    return pa.table({"id": ids, "piece": pa.array(piece, pa.int64()), "bin_id": pa.array([(shard << 32) + b for b in no], pa.int64()),
                     "start": pa.array(start, pa.int64()), "n_tokens": pa.array(size, pa.int64())})


def numbered(counted: DataFrame, part: int = 1 << 16) -> DataFrame:
    """Each row ``count`` times, with its number ``nth``. Numbers are made in parts of ``part``, each in a task of
    its own choice."""
    last = F.floor((F.col("count") - 1) / part)
    d = counted.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    d = d.repartition("part", *[c for c in counted.columns if c != "count"])
    first = F.col("part") * part
    return d.withColumn("nth", F.explode(F.sequence(first, F.least(first + part, F.col("count")) - 1))).drop("part", "count")


def pack(docs: DataFrame, length_col: str, id_col: str = "doc_id", source_col: str = "source", cluster_col: str = "cluster",
         capacity: int = 2048, shard_rows: int = 4096) -> DataFrame:
    """One row per piece: id, piece, bin_id, start, n_tokens.

    Longer documents are cut in pieces of ``capacity`` and a rest. No bin holds two documents of one source or of
    one cluster; a null source or cluster conflicts with nothing. Documents of length zero, negative or null get
    one row without a bin. Repeated rows and null ids are packed like others; other columns are not read.
    A shard has about ``shard_rows`` documents whatever the input: equal rows are counted first and dealt out by their
    number among their like, so neither a hot source nor a hot row fills a shard; ids, lengths and conflict keys alone
    are shuffled. Very long documents make many pieces, one row each.
    """
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(length_col).cast("long"), F.lit(0)).alias("length"),
                    F.col(source_col).cast("string").alias("source"), F.col(cluster_col).cast("string").alias("cluster"))
    d = stored(d.groupBy(*d.columns).count())
    shards = max(1, -(-(d.agg(F.sum("count")).first()[0] or 0) // shard_rows))
    d = numbered(d).withColumn("shard", F.pmod(F.xxhash64("id", "cluster", "length", "nth"), F.lit(shards)))
    kind = docs.schema[id_col].dataType.simpleString()
    packed = (d.where("length > 0").groupBy("shard")
              .applyInArrow(lambda t: pack_shard(t, capacity), f"id {kind}, piece long, bin_id long, start long, n_tokens long"))
    empty = d.where("length <= 0").select("id", F.lit(0).cast("long").alias("piece"), F.lit(None).cast("long").alias("bin_id"),
                                          F.lit(None).cast("long").alias("start"), F.lit(0).cast("long").alias("n_tokens"))
    return packed.unionByName(empty).withColumnRenamed("id", id_col)
