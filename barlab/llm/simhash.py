"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints that differ in at most four bits agree in one of five bit blocks, so Spark deals distinct fingerprints
out by (block, its bits). Inside a bucket they are sorted by Gray rank and grouped level by level: a node holds the
bits that all its members share and that its parent does not fix yet. A fingerprint goes down from the root, adds up
the differences with the shared bits, and leaves a whole group as soon as the sum exceeds the limit, or as soon as
the group is known to belong to its own component. Buckets give spanning edges, never all pairs.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.store import stored
from .components import components
from .textbytes import WHITE, slices, squeezed, word_bounds, xxh64

BITS, LIMIT, FANOUT = 64, 4, 8
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  # first bit, width: one more than the limit
ROWS = 1 << 18
CROWD = 1 << 17


def fingerprint_slice(data: np.ndarray, off: np.ndarray, shingle: int) -> np.ndarray:
    """``data``: squeezed words of texts. Fingerprints of the texts."""
    starts, ends = word_bounds(~WHITE[data])
    words = np.searchsorted(starts, off)
    n = np.diff(words)
    last = np.minimum(np.arange(len(starts)) + shingle, np.repeat(words[1:], n)) - 1
    # shingles that begin at a word: all but the last few, at least the first
    begin = np.arange(len(starts)) - np.repeat(words[:-1], n)
    use = (begin == 0) | (begin + shingle <= np.repeat(n, n))
    h = xxh64(data, starts[use], ends[last[use]], 42)
    per = np.maximum(n - shingle + 1, n > 0)
    out = np.zeros(len(n), dtype=np.uint64)
    full = np.flatnonzero(per)
    if len(full):
        ones = bit_counts(h, per[full])
        out[full] = np.packbits(2 * ones > per[full][:, None], axis=1).view(np.uint64)[:, 0]
    return out


def bit_counts(h: np.ndarray, per: np.ndarray) -> np.ndarray:
    """How often each bit is set in each group of ``per`` (at least 1) values: groups x 64, as ``unpackbits`` orders
    them. Eight bits are added at once, a byte for each, in stretches of at most 255 values."""
    stretches = -(-per // 255)
    first = np.cumsum(stretches) - stretches              # of a group, among stretches
    inside = np.arange(int(stretches.sum())) - np.repeat(first, stretches)
    start = np.repeat(np.cumsum(per) - per, stretches) + 255 * inside
    out = np.empty((len(per), 8, 8), dtype=np.int64)
    for k in range(8):
        sums = np.add.reduceat((h >> np.uint64(k)) & np.uint64(0x0101010101010101), start)
        out[:, :, 7 - k] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
    return out.reshape(len(per), 64)


def fingerprinter(shingle: int = 4):
    @F.arrow_udf("long")
    def fingerprint(texts: pa.Array) -> pa.Array:
        parts = [fingerprint_slice(*squeezed(s, ~WHITE[s.data]), shingle) for s in slices(texts)]
        return pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64))
    return fingerprint


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a code word in the reflected Gray sequence: neighbours there differ in one bit."""
    r = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """Forest of one tree per bucket over rows sorted by (bucket, Gray rank)."""

    def __init__(self, bucket: np.ndarray, x: np.ndarray, fanout: int = FANOUT):
        order = np.lexsort((gray_rank(x), bucket))
        self.order, self.x = order, x[order]
        b = bucket[order]
        n = len(b)
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        # per level: first child, first and last row, the bits shared by all members
        self.levels = [(np.arange(n), np.arange(n), np.arange(n), self.x, np.full(n, full))]
        while True:
            _, lo, hi, pat, mask = self.levels[-1]
            owner = b[lo]
            new = np.concatenate([[True], owner[1:] != owner[:-1]])
            if new.all():
                break
            run = np.flatnonzero(new)
            place = np.arange(len(lo)) - np.repeat(run, np.diff(np.append(run, len(lo))))
            head = np.flatnonzero(place % fanout == 0)
            size = np.diff(np.append(head, len(lo)))
            p = pat[head]
            same = np.bitwise_and.reduceat(mask & ~(pat ^ np.repeat(p, size)), head)
            self.levels.append((head, lo[head], hi[np.append(head[1:], len(lo)) - 1], p, same))
        # a level keeps only the shared bits its parent has not fixed
        self.residual = []
        for k, lv in enumerate(self.levels):
            if k + 1 < len(self.levels):
                head = self.levels[k + 1][0]
                up = np.repeat(self.levels[k + 1][4], np.diff(np.append(head, len(lv[1]))))
                self.residual.append(lv[4] & ~up)
            else:
                self.residual.append(lv[4])
        top = self.levels[-1]
        self.root = np.repeat(np.arange(len(top[1])), top[2] - top[1] + 1)

    def walk(self, q: np.ndarray, label: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Pairs of rows (query, later row) within ``limit``, but for groups already in the query's component.
        Also the largest number of nodes open at once."""
        k = len(self.levels) - 1
        node, acc, widest = self.root[q], np.zeros(len(q), dtype=np.uint8), len(q)
        uniform = []
        for _, lo, hi, _, _ in self.levels[1:]:
            a, b = np.minimum.reduceat(label, lo), np.maximum.reduceat(label, lo)
            uniform.append(np.where(a == b, a, -1))
        while True:
            _, lo, hi, pat, _ = self.levels[k]
            acc = acc + np.bitwise_count((self.x[q] ^ pat[node]) & self.residual[k][node])
            open_ = (acc <= limit) & (hi[node] > q)
            if k:
                open_ &= uniform[k - 1][node] != label[q]
            q, node, acc = q[open_], node[open_], acc[open_]
            if k == 0:
                return q, node, widest
            head = self.levels[k][0]
            below = len(self.levels[k - 1][1])
            last = np.append(head[1:], below)
            size = last[node] - head[node]
            widest = max(widest, int(size.sum()))
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            child = np.repeat(head[node] - first, size) + np.arange(int(size.sum()))
            q, acc, node, k = np.repeat(q, size), np.repeat(acc, size), child, k - 1

    def spanning(self, limit: int = LIMIT, most: int = 1 << 20) -> list[tuple[int, int]]:
        """Edges (positions in the input) that connect exactly what all links connect."""
        n = len(self.x)
        label, edges, i, step = np.arange(n), [], 0, 64
        while i < n:
            q = np.arange(i, min(n, i + step))
            a, b, widest = self.walk(q, label, limit)
            if widest > most and len(q) > 1:
                step = max(1, step // 4)
                if widest > 8 * most:
                    continue
            elif widest < most // 4:
                step = min(step * 2, 1 << 14)
            i += len(q)
            far = label[a] != label[b]
            if far.any():
                parent: dict[int, int] = {}

                def root(v: int) -> int:
                    while (p := parent.get(v, v)) != v:
                        parent[v] = v = parent.get(p, p)
                    return v
                for u, v in zip(a[far].tolist(), b[far].tolist()):
                    ru, rv = root(int(label[u])), root(int(label[v]))
                    if ru != rv:
                        parent[max(ru, rv)] = min(ru, rv)
                        edges.append((u, v))
                to = np.arange(n)
                for v in parent:
                    to[v] = root(v)
                label = to[label]
        return [(int(self.order[u]), int(self.order[v])) for u, v in edges]


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; whole buckets are indexed together, about ROWS rows at a time."""
    def emit(bucket: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        fp = x.view(np.uint64)
        e = GrayIndex(bucket, fp).spanning() if len(x) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([int(x[i]) for i, _ in e], pa.int64()), pa.array([int(x[j]) for _, j in e], pa.int64())], ["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for t in batches:
        if not t.num_rows:
            continue
        held.append((t.column("bucket").to_numpy(), t.column("fp").to_numpy()))
        size += t.num_rows
        if size >= ROWS:
            k, x = (np.concatenate([h[c] for h in held]) for c in (0, 1))
            cut = int(np.searchsorted(k, k[-1]))
            if cut:
                yield emit(k[:cut], x[:cut])
            held, size = [(k[cut:], x[cut:])], len(k) - cut
    if size:
        yield emit(*(np.concatenate([h[c] for h in held]) for c in (0, 1)))


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, spanning the links inside each bucket.

    A bucket of more than ``crowd`` fingerprints is cut in parts by hash and every two parts meet in a task of
    their own, so that no task holds more than about twice that many of one bucket.
    """
    block = F.array(*[F.struct(F.lit(i).alias("no"), F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << w) - 1)).alias("bits"))
                      for i, (at, w) in enumerate(BLOCKS)])
    each = fps.select("fp", F.explode(block).alias("b")).select("fp", ((F.col("b.no").cast("long") * 8192 + F.col("b.bits")) * (1 << 32)).alias("bucket"))
    parts = each.groupBy("bucket").count().where(F.col("count") > crowd).select("bucket", F.ceil(F.col("count") / crowd).cast("int").alias("k"))
    own = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    other = F.explode(F.when(F.col("k").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("k") - 1)))
    cut = each.join(parts, "bucket", "left").select("fp", "bucket", "k", other.alias("j"))
    no = F.when(F.col("k").isNull(), F.lit(0)).otherwise(F.least(own, "j") * F.col("k") + F.greatest(own, "j")).cast("long")
    dealt = cut.select((F.col("bucket") + no).alias("bucket"), "fp").repartition("bucket").sortWithinPartitions("bucket", "fp")
    return dealt.mapInArrow(_link, "a long, b long")


def _fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, *more) -> DataFrame:
    return stored(docs.select(F.col(id_col).alias("id"), *more, fingerprinter(shingle)(F.col(text_col)).alias("fp")))


def _groups(fp: DataFrame) -> DataFrame:
    """fp, root (a fingerprint that stands for the component) and component_id of every distinct fingerprint."""
    distinct = stored(fp.groupBy("fp").agg(F.min("id").alias("low")))
    joined = components(links(distinct.select("fp")))
    rooted = distinct.join(joined.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rooted.join(lows, "root").select("fp", "root", "component_id")


def clustered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column, shingle: int = 4) -> DataFrame:
    """One row per document: id, the named columns ``more``, and cluster, a fingerprint that stands for the component.
    Unlike component_id it is never null. Texts are read once, for the fingerprint and for ``more``."""
    fp = _fingerprints(docs, id_col, text_col, shingle, *more)
    kept = [c for c in fp.columns if c not in ("id", "fp")]
    return fp.join(_groups(fp), "fp").select(F.col("id").alias(id_col), *kept, F.col("root").alias("cluster"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """One row per document: id, fp (long), component_id, the smallest id linked to it directly or through others.

    Words lie between ASCII white space, A-Z lower-cased. Null and blank texts have fingerprint zero and are linked
    like others. Repeated rows stay; null ids are no component id unless a component has no other. Texts are read
    once and not shuffled; everything after works on distinct fingerprints.
    """
    fp = _fingerprints(docs, id_col, text_col, shingle)
    return fp.join(_groups(fp), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def fingerprint_hex(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """The document with the smallest id of each component, with all columns; of repeated rows with that id one. The
    texts are shuffled once, by a hash of id and text that meets the rows to keep."""
    rid = F.xxhash64(F.col(id_col), F.col(text_col))
    fp = _fingerprints(docs, id_col, text_col, shingle, rid.alias("rid"))
    kept = fp.join(_groups(fp), "fp").where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("rid").alias("rid")).select("rid")
    one = Window.partitionBy("rid").orderBy(F.xxhash64("row"))
    return (docs.select(F.struct("*").alias("row"), rid.alias("rid")).join(kept, "rid", "left_semi")
            .withColumn("nth", F.row_number().over(one)).where("nth = 1").select("row.*"))
