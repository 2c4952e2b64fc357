"""Benchmark decontamination: Wu-Manber search for word windows of benchmark items in whole documents.

Windows are byte patterns over lower-cased words. Patterns are grouped by length, so that a short one does not
shorten the skips of the others. In each group a table gives, for the hash of the last few bytes under the
search window, how far the window may move; where it may not, the bucket of that hash lists the patterns whose
first bytes are then compared, and survivors are compared in full. A text is cut in lanes that move on
together, one numpy step for all lanes.
"""
from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.store import stored
from .textbytes import counts_between, slices, squeezed, word_bounds

WORD = np.array([b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_MULT = np.uint64(0x9E3779B97F4A7C15)
LANE = 2048


def item_windows(text: str | None, window: int) -> set[bytes]:
    w = _WORDS.findall((text or "").translate(_LOWER))
    n = min(window, len(w))
    return {" ".join(w[i:i + n]).encode() for i in range(len(w) - n + 1)} if n else set()


class Group:
    """Shift table and buckets of the patterns of one range of lengths."""

    def __init__(self, pats: list[bytes], ids: np.ndarray):
        self.pats, self.ids = pats, ids
        self.m = min(map(len, pats))
        self.block = 16 if self.m >= 32 else 8 if self.m >= 12 else min(self.m, 4)
        self.bits = 20
        default = self.m - self.block + 1
        self.shift = np.full(1 << self.bits, default, dtype=np.int32)
        head = np.frombuffer(b"".join(p[:self.m] for p in pats), dtype=np.uint8).reshape(len(pats), self.m)
        for end in range(self.block, self.m + 1):
            h = self.hashes(np.ascontiguousarray(head[:, end - self.block:end]))
            np.minimum.at(self.shift, h, self.m - end)
        order = np.argsort(h, kind="stable")  # h: of the last block
        self.order = order
        self.keys, first = np.unique(h[order], return_index=True)
        self.first = np.append(first, len(order))
        self.prefix = self.packed(head[:, :8])

    @staticmethod
    def packed(b: np.ndarray) -> np.ndarray:
        """Up to eight bytes of each row as one integer."""
        out = np.zeros((len(b), 8), dtype=np.uint8)
        out[:, :min(8, b.shape[1])] = b[:, :8]
        return out.view(np.uint64)[:, 0]

    def hashes(self, b: np.ndarray) -> np.ndarray:
        h = self.packed(b[:, -8:])
        if b.shape[1] > 8:
            h = (self.packed(b[:, :-8]) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (h >> np.uint64(7)) ^ h
        return ((h * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, data: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Starts of confirmed occurrences and the pattern numbers."""
        n, m = len(data), self.m
        if n < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lo = np.arange(m, n + 1, LANE)                 # positions are ends of the search window
        hi = np.minimum(lo + LANE, n + 1)
        pos, out_at, out_k = lo, [], []
        blocks = np.lib.stride_tricks.sliding_window_view(data, self.block)
        heads = np.lib.stride_tricks.sliding_window_view(data, min(8, m))
        while len(pos):
            h = self.hashes(blocks[pos - self.block])
            s = self.shift[h]
            stop = np.flatnonzero(s == 0)
            if len(stop):
                p, b = pos[stop] - m, np.searchsorted(self.keys, h[stop])
                c = np.minimum(b, len(self.keys) - 1)
                real = self.keys[c] == h[stop]
                p, c = p[real], c[real]
                size = self.first[c + 1] - self.first[c]
                start = np.repeat(p, size)
                k = self.order[np.repeat(self.first[c] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
                like = self.packed(heads[start]) == self.prefix[k]
                out_at.append(start[like])
                out_k.append(k[like])
                s = np.maximum(s, 1)
            pos = pos + s
            on = pos < hi
            if not on.all():
                pos, hi = pos[on], hi[on]
        if not out_at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, k = np.concatenate(out_at), np.concatenate(out_k)
        inner = (at == 0) | ~WORD[data[at - 1]]
        at, k = at[inner], k[inner]
        ok = np.fromiter((raw.startswith(self.pats[j], i) and not WORD[raw[i + len(self.pats[j])]]
                          for i, j in zip(at.tolist(), k.tolist())), dtype=bool, count=len(at))
        return at[ok], k[ok]


class WuManber:
    """Patterns with the items they come from."""

    def __init__(self, pairs: list[tuple[bytes, str]]):
        of: dict[bytes, set[str]] = {}
        for p, item in pairs:
            of.setdefault(p, set()).add(item)
        self.pats = sorted(of)
        self.items = [sorted(of[p]) for p in self.pats]
        kinds: dict[int, list[int]] = {}
        for i, p in enumerate(self.pats):
            kinds.setdefault(min(len(p), 1 << 9).bit_length(), []).append(i)
        self.groups = [Group([self.pats[i] for i in ids], np.array(ids)) for _, ids in sorted(kinds.items())]

    def scan(self, texts: pa.Array, before: tuple[pa.Array, pa.Array] | None):
        """Per text: words, hit stretches (flat, disjoint, sorted) and items; ``before`` are those of earlier patterns."""
        words, hits, items = [], [], []
        for s in slices(texts):
            data, off = squeezed(s, WORD[s.data])
            starts, ends = word_bounds(WORD[data])
            raw = data.tobytes()
            words += counts_between(starts, off).tolist()
            at, k = [], []
            for g in self.groups:
                a, j = g.search(data, raw)
                at.append(a)
                k.append(g.ids[j])
            at, k = np.concatenate(at or [[]]).astype(np.int64), np.concatenate(k or [[]]).astype(np.int64)
            text = np.searchsorted(off, at, side="right") - 1
            order = np.lexsort((at, text))
            at, k, text = at[order], k[order], text[order]
            size = np.fromiter((len(self.pats[j]) for j in k.tolist()), dtype=np.int64, count=len(k))
            base = np.searchsorted(starts, off)
            w0 = np.searchsorted(starts, at) - base[text]
            w1 = np.searchsorted(ends, at + size, side="right") - base[text]
            cut = np.searchsorted(text, np.arange(len(off)))
            for i in range(len(off) - 1):
                a, b = cut[i], cut[i + 1]
                old_h, old_i = ([], []) if before is None else (before[0][s.first + i].as_py(), before[1][s.first + i].as_py())
                if a == b:
                    hits.append(old_h)
                    items.append(old_i)
                    continue
                hits.append(merged([*zip(old_h[0::2], old_h[1::2]), *zip(w0[a:b].tolist(), w1[a:b].tolist())]))
                items.append(sorted({x for j in set(k[a:b].tolist()) for x in self.items[j]} | set(old_i)))
        return words, hits, items


def merged(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


RESULT = "n_words long, hits array<long>, items array<string>"
_ARROW = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())]


_BUILT: dict[str, WuManber] = {}  # of this worker: the tables of the last patterns, for all tasks it runs


def _tables(key: str, pairs) -> WuManber:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = WuManber(pairs.value)
    return _BUILT[key]


def _scanner(spark: SparkSession, pairs: list[tuple[bytes, str]], later: bool):
    shared, key = spark.sparkContext.broadcast(pairs), uuid.uuid4().hex

    def run(texts, before):
        cols = _tables(key, shared).scan(texts, before)
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, _ARROW)], ["n_words", "hits", "items"])

    if not later:
        @F.arrow_udf(RESULT)
        def first(texts: pa.Array) -> pa.Array:
            return run(texts, None)
        return first

    @F.arrow_udf(RESULT)
    def more(texts: pa.Array, state: pa.Array) -> pa.Array:
        return run(texts, (state.field("hits"), state.field("items")))
    return more


def with_matches(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_id: str = "item_id",
                 item_text: str = "text", window: int = 13, block_bytes: int = 2 << 20) -> DataFrame:
    """Columns ``row`` (all columns of docs) and ``m``: n_words, hits (flat word stretches), items.

    The driver holds and broadcasts at most about ``block_bytes`` of benchmark text at a time, which as windows is
    up to ``window`` times that (about 300 MB with their tables in a worker at 2 MB): the benchmark is read in blocks
    of that size and each further block scans the texts again, adding to what the blocks before found. Null texts have no words; items without words or with a null
    id are left out; equal items all count. No shuffle of documents.
    """
    spark = docs.sparkSession
    use = bench.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text")).where("id is not null and text is not null")
    size = use.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = None
    for b in range(blocks):
        part = use if blocks == 1 else use.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)
        pairs = [(w, r["id"]) for r in part.toLocalIterator() for w in item_windows(r["text"], window)]
        scan = _scanner(spark, pairs, later=b > 0)
        if out is None:
            out = docs.select(F.struct("*").alias("row"), scan(F.col(text_col)).alias("m"))
        else:
            out = stored(out)
            out = out.select("row", scan(F.col("row")[text_col], F.col("m")).alias("m"))
    return out


def hit_count(m):
    return F.aggregate(F.transform(m["hits"], lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)


def contaminated(m):
    """At least one word hit, and at least one word in twenty."""
    return (hit_count(m) > 0) & (20 * hit_count(m) >= m["n_words"])


def report(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, the digest of the item ids and the verdict."""
    m = F.col("m")
    return (with_matches(docs.select(F.col(id_col), F.col(kw.get("text_col", "text"))), bench, **kw)
            .select(F.col("row")[id_col].alias(id_col), m["n_words"].alias("n_words"), hit_count(m).alias("n_hit"),
                    F.size(m["items"]).cast("long").alias("n_items"),
                    F.sha2(F.array_join(F.array_sort(m["items"]), ","), 256).alias("items_sha256"),
                    contaminated(m).alias("contaminated")))


def keep_clean(docs: DataFrame, bench: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    return with_matches(docs, bench, **kw).where(~contaminated(F.col("m"))).select("row.*")
