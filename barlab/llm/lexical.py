"""Ranked lexical search with the Best Position Algorithm.

Every document gets a forward vector: the query terms it holds, with their numbers. Blocks of vectors are turned into
impact lists in Spark tasks, one list a term, documents by falling contribution to a score. For one query the lists of
its terms are read in parallel from the top (sorted access); a document met for the first time is scored at once from
its vector (direct access), which also tells its position in every other list. The best position of a list is the last
one up to which all positions have been seen, by either access. No document unseen so far can score more than the sum
of the contributions at the best positions; reading stops when that sum is strictly below the score of rank k, so that
equal scores are still met and ranked by id. What a task has found carries over to its next block.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..operators.store import stored
from .textbytes import LOWER, Powers, RollingHash, Slice, byte_table, mixed, slices, word_bounds

# ASCII letters and digits; every byte of a longer character belongs to a term.
TERM = byte_table(bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]))
_ITEM_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_FOLD = {c: c + 32 for c in range(65, 91)}
_POWERS = Powers(0x9E3779B97F4A7C15)
ENTRIES = 1 << 20


def terms_of(text: str | None) -> list[str]:
    """Terms in order, A-Z lower-cased; null has none."""
    return [t.translate(_FOLD) for t in _ITEM_TERM.findall(text or "")]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    h = RollingHash(data.astype(np.uint64) + np.uint64(1), _POWERS)
    return mixed(h.of(starts, ends) + (ends - starts).astype(np.uint64))


class Vocabulary:
    """Query terms, found among the words of many texts at once."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        self.data = np.frombuffer(b"".join(raw) + b"\n", dtype=np.uint8)
        ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
        starts = ends - np.array([len(r) for r in raw], dtype=np.int64)
        h = hashes(self.data, starts, ends)
        self.order = np.argsort(h, kind="stable")
        self.sorted, self.starts, self.lengths = h[self.order], starts, ends - starts
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(h & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the words that are terms, and which term. Hashes select, bytes decide."""
        h = hashes(data, starts, ends)
        at = np.flatnonzero(self.maybe[(h & np.uint64(0xFFFFF)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.sorted, h[at]), len(self.sorted) - 1)
        ok = self.sorted[place] == h[at]
        at, term = at[ok], self.order[place[ok]]
        ok = self.lengths[term] == ends[at] - starts[at]
        at, term = at[ok], term[ok]
        size = self.lengths[term]
        first = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(first, size)
        differs = data[np.repeat(starts[at], size) + step] != self.data[np.repeat(self.starts[term], size) + step]
        if differs.any():
            same = np.ones(len(at), dtype=bool)
            same[np.repeat(np.arange(len(at)), size)[differs]] = False
            at, term = at[same], term[same]
        return at, term


def vectors_slice(s: Slice, vocabulary: Vocabulary | None) -> pa.StructArray:
    data, n_texts = LOWER[s.data], len(s.off) - 1
    starts, ends = word_bounds(TERM[data])
    n = np.diff(np.searchsorted(starts, s.off))
    if vocabulary is None or not len(starts):
        key, tf, width = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
    else:
        at, term = vocabulary.find(data, starts, ends)
        width = len(vocabulary.lengths)
        key, tf = np.unique(np.repeat(np.arange(n_texts), n)[at] * width + term, return_counts=True)
    off = pa.array(np.searchsorted(key, np.arange(n_texts + 1) * width).astype(np.int32))
    return pa.StructArray.from_arrays([pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(off, pa.array((key % width).astype(np.int32))),
                                       pa.ListArray.from_arrays(off, pa.array(tf.astype(np.int32)))], ["n", "term", "tf"])


def vectorizer(spark: SparkSession, terms: list[str]):
    """Arrow UDF: text -> n (terms with repeats), term (numbers of the query terms in it), tf."""
    shared = spark.sparkContext.broadcast(Vocabulary(terms) if terms else None)

    @F.arrow_udf("n long, term array<int>, tf array<int>")
    def vectorize(texts: pa.Array) -> pa.Array:
        empty = Slice(0, 0, np.zeros(0, np.uint8), np.zeros(1, np.int64))
        return pa.concat_arrays([vectors_slice(s, shared.value) for s in slices(texts)] or [vectors_slice(empty, None)])

    return vectorize


@dataclass(frozen=True)
class Weights:
    """``w`` by term; ``total``: documents with a term; ``length``: all their terms."""
    w: np.ndarray
    total: int
    length: int

    def contribution(self, term: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 50 + (50 * n * self.total) // max(self.length, 1)
        return self.w[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def weights(df: np.ndarray, total: int, length: int) -> Weights:
    return Weights(np.floor(1000 * np.log((2 * total + 2) / (2 * df + 1))).astype(np.int64), total, length)


class Best:
    """The k best (score, id) so far; equal scores by id, null ids last."""

    def __init__(self, k: int):
        self.k, self.score, self.id, self.null = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def kth(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 0

    def add(self, score: np.ndarray, id_: np.ndarray, null: np.ndarray) -> None:
        use = (score > 0) & (score >= self.kth)
        if use.any():
            score, id_, null = (np.concatenate([a, b[use]]) for a, b in ((self.score, score), (self.id, id_), (self.null, null)))
            order = np.lexsort((id_, null, -score))[:self.k]
            self.score, self.id, self.null = score[order], id_[order], null[order]


class Block:
    """Impact lists and forward vectors of a block of documents."""

    def __init__(self, off: np.ndarray, term: np.ndarray, tf: np.ndarray, n: np.ndarray, ids: np.ndarray, null: np.ndarray, weights: Weights):
        size = np.diff(off)
        self.off, self.term, self.ids, self.null = off, term, ids, null
        doc = np.repeat(np.arange(len(size)), size)
        self.value = weights.contribution(term, tf.astype(np.int64), np.repeat(n, size))
        order = np.lexsort((doc, -self.value, term))
        self.list_doc, self.list_value = doc[order], self.value[order]
        self.position = np.empty(len(order), dtype=np.int64)      # of a vector's entry, among all lists
        self.position[order] = np.arange(len(order))
        self.bounds = np.searchsorted(term[order], np.arange(len(weights.w) + 1))
        self.member = np.zeros(len(weights.w), dtype=bool)
        self.seen = np.zeros(len(order), dtype=bool)
        self.scored = np.zeros(len(size), dtype=bool)

    def direct(self, docs: np.ndarray) -> np.ndarray:
        """Scores of documents for the terms in ``member``; their positions in these lists become seen."""
        size = self.off[docs + 1] - self.off[docs]
        first = np.cumsum(size) - size
        at = np.repeat(self.off[docs] - first, size) + np.arange(int(size.sum()))
        mine = self.member[self.term[at]]
        self.seen[self.position[at[mine]]] = True
        sums = np.concatenate([[0], np.cumsum(self.value[at] * mine)])
        return sums[first + size] - sums[first]

    def search(self, terms: np.ndarray, best: Best, step: int = 16) -> int:
        """Adds what the block has for one query. Returns how many documents were scored."""
        lo, hi = self.bounds[terms], self.bounds[terms + 1]
        use = hi > lo
        terms, lo, hi = terms[use], lo[use], hi[use]
        if not len(terms):
            return 0
        self.member[terms] = True
        position, depth, touched = lo.copy(), 0, []               # first position not seen yet
        while True:
            reach = np.minimum(lo + depth + step, hi)
            read = np.concatenate([self.list_doc[a:b] for a, b in zip(np.minimum(lo + depth, hi), reach)])
            docs = np.unique(read[~self.scored[read]])
            if len(docs):
                self.scored[docs] = True
                touched.append(docs)
                best.add(self.direct(docs), self.ids[docs], self.null[docs])
            for i in range(len(lo)):
                ahead = 64
                while position[i] < hi[i]:
                    part = self.seen[position[i]:min(position[i] + ahead, hi[i])]
                    gap = int(part.argmin())
                    if not part[gap]:
                        position[i] += gap
                        break
                    position[i] += len(part)
                    ahead *= 4
            live = position < hi
            if not live.any() or len(best.score) == best.k and int(self.list_value[position[live] - 1].sum()) < best.kth:
                break
            depth += step
            step *= 2
        for docs in touched:
            self.scored[docs] = False
        for a, b in zip(lo, hi):
            self.seen[a:b] = False
        self.member[terms] = False
        return sum(len(d) for d in touched)


def ranker(queries: list[np.ndarray], weights: Weights, k: int, entries: int = ENTRIES):
    """mapInArrow function over (id, n, term, tf): rows (query, id, score), at most k a query and task."""
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
        held, size = [], 0
        def block():
            t = pa.Table.from_batches(held).combine_chunks()
            col = {c: t.column(c).combine_chunks() for c in t.column_names}
            off = col["term"].offsets.to_numpy().astype(np.int64)
            return Block(off - off[0], col["term"].flatten().to_numpy(zero_copy_only=False), col["tf"].flatten().to_numpy(zero_copy_only=False), col["n"].to_numpy(),
                         col["id"].fill_null(0).to_numpy(zero_copy_only=False), col["id"].is_null().to_numpy(zero_copy_only=False), weights)
        for b in batches:
            done = 0
            while done < b.num_rows:
                off = b.column("term").offsets.to_numpy()
                take = max(1, int(np.searchsorted(off, off[done] + entries - size, side="right")) - 1 - done)
                held.append(b.slice(done, take))
                size += int(off[done + len(held[-1])] - off[done])
                done += len(held[-1])
                if size >= entries or sum(len(x) for x in held) >= entries:
                    yield block()
                    held, size = [], 0
        if held:
            yield block()

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in queries]
        for block in blocks(batches):
            for q, b in zip(queries, best):
                block.search(q, b)
        found = [(i, b) for i, b in enumerate(best) if len(b.score)]
        if found:
            yield pa.record_batch([pa.array(np.repeat([i for i, _ in found], [len(b.score) for _, b in found]).astype(np.int32)),
                                   pa.array(np.concatenate([b.id for _, b in found]), mask=np.concatenate([b.null for _, b in found])),
                                   pa.array(np.concatenate([b.score for _, b in found]))], ["query", "id", "score"])
    return rank


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
           item_text: str = "text", block_bytes: int = 16 << 20) -> DataFrame:
    """The ``k`` best documents for each item: item id, rank from 1, document id (long), score (long), scores above 0.

    Null and blank texts hold no terms and are in no result; items without terms have no rows. Each row of ``items``
    is a query of its own and each row of ``docs`` a document, also where ids or whole rows repeat; equal scores are
    ranked by id, null ids last. Other columns are not read. Items are read in blocks of at most about ``block_bytes``
    of text, whose terms the driver and every worker hold; each block reads the texts once. No text is shuffled: the
    forward vectors are stored, counts by term and k rows a query and task are shuffled. Memory of a task is about
    120 bytes for each of ``ENTRIES`` vector entries, and k rows a query; a very long text is one vector.
    """
    spark = docs.sparkSession
    use = items.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).where(F.col("text").isNotNull())
    size = use.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    parts = []
    for b in range(n_blocks):
        rows = use if n_blocks == 1 else use.where(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == b)
        ids, bags = [], []
        for r in rows.toLocalIterator():
            bag = set(terms_of(r["text"]))
            if bag:
                ids.append(r["id"])
                bags.append(bag)
        terms = sorted(set().union(*bags))
        number = {t: i for i, t in enumerate(terms)}
        known = stored(docs.select(F.col(id_col).cast("long").alias("id"), vectorizer(spark, terms)(F.col(text_col)).alias("v")).select("id", "v.*"))
        counts = known.agg(F.count_if(F.col("n") > 0).alias("total"), F.sum("n").alias("length")).first()
        df = np.zeros(len(terms), dtype=np.int64)
        for r in known.select(F.explode("term").alias("t")).groupBy("t").count().toLocalIterator():
            df[r["t"]] = r["count"]
        queries = [np.array(sorted(number[t] for t in bag), dtype=np.int64) for bag in bags]
        found = known.mapInArrow(ranker(queries, weights(df, counts["total"], counts["length"] or 0), k), "query int, id long, score long")
        names = spark.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("query", T.IntegerType()), T.StructField(item_id, items.schema[item_id].dataType)]))
        parts.append(found.join(names, "query").withColumn("block", F.lit(b)))
    order = Window.partitionBy("block", "query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return (reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select(item_id, "rank", F.col("id").alias(id_col), "score"))
