"""Periodic runs of words, found by catching squares online.

A run is a stretch of words with smallest period q, at least 2q long, that no neighbouring word extends. Every square
of half length p has a block of 2**k words that begins at a multiple of 2**k in its first half, for the k with
2**(k + 1) - 1 <= p <= 2**(k + 2) - 2, and meets that block again p words later. A block that is complete therefore
becomes a catcher: each word appended ends one more suffix of 2**k words, which is compared with the two catchers of
its level that lie p words before it. Where they agree, the agreement is followed to both sides; a stretch of at least
2p words is a square, and squares of one period merge into the run that holds them.

Words arrive in batches of any size; within a batch all suffixes of a level advance together in numpy. Texts lie in one
sequence, each followed by a word that equals no other.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .textbytes import WHITE, Powers, RollingHash, Slice, mixed, slices, word_bounds

_BYTES = Powers(0x9E3779B97F4A7C15)
_LEFT, _RIGHT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
NONE = np.zeros(0, dtype=np.int64)


class Catchers:
    """Runs of the words appended so far. ``longest`` bounds the length of one text (no square can be longer)."""

    def __init__(self, longest: int):
        self.levels = 1
        while (4 << self.levels) - 2 <= longest:
            self.levels += 1
        self.names = [np.zeros(0, dtype=np.uint64) for _ in range(self.levels)]
        self.start, self.end, self.period = NONE, NONE, NONE
        self.open = (NONE, NONE, NONE)                    # agreements up to the last word, too short for a square so far

    @property
    def n(self) -> int:
        return len(self.names[0])

    def append(self, words: np.ndarray) -> None:
        """``words``: 64-bit values. Equal names of 2**k words mean equal words."""
        before = self.n
        for k in range(self.levels):
            old, half = self.names[k], (1 << k) >> 1
            if k == 0:
                new = words
            else:
                low = self.names[k - 1]
                at = np.arange(len(old), max(len(low) - half, len(old)))
                new = mixed(low[at] * _LEFT + (low[at + half] ^ _RIGHT))
            self.names[k] = np.concatenate([old, new])
        self._grow(before)
        for k in range(self.levels):
            self._catch(k, max(0, before - (1 << k) + 1))
        self.open = tuple(x[self.open[1] == self.n] for x in self.open)

    def _grow(self, before: int) -> None:
        """Runs and agreements that touched the last word go on."""
        live = np.flatnonzero(self.end == before)
        if before and len(live):
            self.end[live] += self._agree(self.end[live] - self.period[live], self.end[live], 1)
        start, end, period = self.open
        if len(start):
            self._sort_out(start, end + self._agree(end - period, end, 1), period)

    def _agree(self, a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
        """How many words from a on (``way`` 1) or up to a - 1 (-1) equal those at b. b is after a."""
        done = np.zeros(len(a), dtype=np.int64)
        left = self.n - b if way == 1 else a
        for k in range(self.levels - 1, -1, -1):
            s, names = 1 << k, self.names[k]
            live = np.arange(len(a))
            while len(live):                              # one step a level, more at the top
                live = live[left[live] - done[live] >= s]
                d = done[live] if way == 1 else -done[live] - s
                live = live[names[a[live] + d] == names[b[live] + d]]
                done[live] += s
                if k < self.levels - 1:
                    break
        return done

    def _catch(self, k: int, first: int) -> None:
        """Suffixes of 2**k words that begin at ``first`` or later meet the catchers of their level."""
        s, names = 1 << k, self.names[k]
        found_at, found_block = [], []
        for back in (2 * s - 1, 3 * s - 1):
            j = np.arange(max(first, back), len(names))
            block = (j - back) >> k << k
            hit = np.flatnonzero(names[j] == names[block])
            found_at.append(j[hit])
            found_block.append(block[hit])
        at, block = np.concatenate(found_at), np.concatenate(found_block)
        if not len(at):
            return
        # a stretch inside a run of a period up to s has no smallest period of its own
        fine = np.flatnonzero(self.period <= s)
        if len(fine):
            fine = fine[np.argsort(self.start[fine], kind="stable")]
            reach = np.concatenate([[-1], np.maximum.accumulate(self.end[fine])])
            new = reach[np.searchsorted(self.start[fine], block, side="right")] < at + s
            at, block = at[new], block[new]
        p = at - block
        start = block - self._agree(block, at, -1)
        end = at + s + self._agree(block + s, at + s, 1)
        self._sort_out(start, end, p)

    def _sort_out(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        square = end - start >= 2 * period
        self._merge(start[square], end[square], period[square])
        wait = ~square & (end == self.n)
        self.open = tuple(np.concatenate([x, y[wait]]) for x, y in zip(self.open, (start, end, period)))

    def _merge(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        """Squares join their runs; of one stretch only the smallest period stays."""
        start, end, period = (np.concatenate(x) for x in ((self.start, start), (self.end, end), (self.period, period)))
        order = np.lexsort((period, end, start))
        start, end, period = start[order], end[order], period[order]
        keep = np.ones(len(start), dtype=bool)
        keep[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        self.start, self.end, self.period = start[keep], end[keep], period[keep]


def runs_of(words: np.ndarray, longest: int | None = None, batch: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (exclusive) and smallest periods of all runs, by start, then end."""
    c = Catchers(len(words) if longest is None else longest)
    for i in range(0, len(words), batch or max(len(words), 1)):
        c.append(words[i:i + batch] if batch else words)
    return c.start, c.end, c.period


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def runs_slice(s: Slice, min_length: int) -> pa.StructArray:
    data, n_texts = s.data, len(s.off) - 1
    starts, ends = word_bounds(~WHITE[data])
    first = np.searchsorted(starts, s.off)
    text = np.repeat(np.arange(n_texts), np.diff(first))
    h = RollingHash(data.astype(np.uint64) + np.uint64(1), _BYTES)
    seq = np.empty(len(starts) + n_texts, dtype=np.uint64)
    seq[np.arange(len(starts)) + text] = mixed(h.of(starts, ends) + (ends - starts).astype(np.uint64))
    seq[first[1:] + np.arange(n_texts)] = mixed(np.arange(n_texts, dtype=np.uint64) * _LEFT + _RIGHT)
    a, b, q = runs_of(seq, int(np.diff(first).max(initial=0)))
    long = b - a >= np.maximum(min_length, 2 * q)
    a, b, q = a[long], b[long], q[long]
    order = np.lexsort((q, a))
    a, b, q = a[order], b[order], q[order]
    of = np.searchsorted(first + np.arange(n_texts + 1), a, side="right") - 1
    per = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n_texts))])
    rows = pa.StructArray.from_arrays([pa.array(a - first[of] - of), pa.array(b - a), pa.array(q)], fields=list(RUN))
    # words after the first period of a run go
    step = np.zeros(len(seq) + 1, dtype=np.int64)
    np.add.at(step, a + q, 1)
    np.add.at(step, b, -1)
    kept = np.flatnonzero(np.cumsum(step)[np.arange(len(starts)) + text] == 0)
    last = np.ones(len(kept), dtype=bool)
    last[:-1] = text[kept[1:]] != text[kept[:-1]]
    step = np.zeros(len(data) + 2, dtype=np.int8)         # kept words and the blank after them do not overlap
    step[starts[kept]] += 1
    step[ends[kept] + ~last] -= 1
    stay = np.cumsum(step[:len(data)], dtype=np.int8) > 0
    out = data.copy()
    out[WHITE[out]] = 32
    off = np.concatenate([[0], np.cumsum(stay)])[s.off]
    collapsed = pa.LargeStringArray.from_buffers(n_texts, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(out[stay])).cast(pa.string())
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(per.astype(np.int32)), rows), collapsed, pa.array(np.diff(first))],
                                      ["runs", "collapsed", "n_words"])


def finder(min_length: int = 12):
    """Arrow UDF: text -> runs (start, length, period in words, by start, then period), collapsed (the words that no
    run holds after its first period, with one space between them) and n_words."""

    @F.arrow_udf("runs array<struct<start: long, length: long, period: long>>, collapsed string, n_words long")
    def find(texts: pa.Array) -> pa.Array:
        parts = [runs_slice(s, min_length) for s in slices(texts)]
        return pa.concat_arrays(parts) if parts else runs_slice(Slice(0, 0, np.zeros(0, np.uint8), np.zeros(1, np.int64)), min_length)

    return find


def with_runs(docs: DataFrame, text_col: str = "text", min_length: int = 12) -> DataFrame:
    """Columns ``row`` (all columns of docs) and ``r``: runs, collapsed, n_words.

    Words are stretches without ASCII white space. A null, empty or blank text has no words, no runs and an empty
    collapsed text. Repeated rows are read one by one; other columns, whatever their names, come along inside ``row``.
    A run has at least ``min_length`` words and twice its period; of equal stretches the smallest period counts. No
    shuffle. Memory of a task is about 8 log2(n) bytes a word of one slice (1 MB of texts, or one longer text of n words).
    """
    return docs.select(F.struct("*").alias("row"), finder(min_length)(F.col(text_col)).alias("r"))


def repeating_tail(text: Column, key: Column) -> Column:
    """The text with its words from one on replaced by a repetition of the first of them, if the key says so: h being
    the crc32 of the key as text, g = h div 10, for h % 10 = 0 words from g % n on repeat with period
    1 + (n - a) div (3 + g % 8). Other texts, null and blank ones, and those of a null key stay."""
    h = F.crc32(key.cast("string"))
    g = F.floor(h / 10)
    w = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size(w)
    a = F.pmod(g, n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), F.array_join(F.concat(F.slice(w, F.lit(1), a), tail), " ")).otherwise(text)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_runs, the longest run and the digests, over texts with ``repeating_tail``."""
    d = with_runs(docs.select(F.col(id_col).alias("key"), repeating_tail(F.col(text_col), F.col(id_col)).alias("text")), "text")
    runs = F.col("r.runs")
    best = F.array_max(F.transform(runs, lambda x: F.struct(x["length"].alias("n"), (-x["start"]).alias("s"), (-x["period"]).alias("p"))))
    listed = F.array_join(F.transform(runs, lambda x: F.concat(x["start"], F.lit(","), x["length"], F.lit(","), x["period"], F.lit("\n"))), "")
    d = d.select(F.col("row.key").alias(id_col), F.size(runs).cast("long").alias("n_runs"), best.alias("b"), F.sha2(listed, 256).alias("runs_sha256"),
                 F.sha2("r.collapsed", 256).alias("collapsed_sha256"))
    b = F.col("b")
    return d.select(id_col, "n_runs", (-b["s"]).alias("start"), b["n"].alias("length"), (-b["p"]).alias("period"),
                    F.floor(1000 * b["n"] / -b["p"]).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
