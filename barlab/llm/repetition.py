"""Quality rules: how much of a text lies inside repeated word n-grams and repeated lines.

Words are runs without ASCII white space. Rolling hashes of several n-gram lengths are taken in numpy over
whole texts; windows and lines are equal when their 64-bit hashes are.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .textbytes import WHITE, Powers, RollingHash, Slice, byte_table, counts_between, mixed, slices, word_bounds

SYMBOLS = byte_table(b"#*$%&|<>")
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BY_BYTE = Powers(0xD1342543DE82EF95)
_BY_WORD = Powers(0xAF251AF3B0F025B5)


@dataclass(frozen=True)
class Limits:
    """The verdict. ``coverage``: largest share of the characters of words inside repeated n-grams of each
    length; ``line_chars``: largest share inside lines that equal an earlier one; ``symbols``: most symbols per
    word. Longer n-grams are allowed less, since they repeat by chance less often; the shortest catches words
    repeated in a row. The base rule (too few words, too many repeated 5-word windows) comes first; words in longer
    repeated n-grams are among those it counts, so these limits lie well under ``repeat_pct``."""
    coverage: dict[int, float] = field(default_factory=lambda: {4: 0.50, 6: 0.14, 8: 0.12, 10: 0.10})
    line_chars: float = 0.10
    symbols: float = 0.10
    min_words: int = 10
    repeat_pct: int = 20
    window: int = 5


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs at least twice. Counts per hash cell leave few keys to sort."""
    out = np.zeros(len(keys), dtype=bool)
    if len(keys) < 2:
        return out
    bits = np.uint64(64 - min(24, max(8, int(len(keys)).bit_length() + 2)))
    cell = (keys >> bits).astype(np.int64)
    at = np.flatnonzero(np.bincount(cell)[cell] > 1)
    order = at[np.argsort(keys[at])]
    k = keys[order]
    same = k[1:] == k[:-1]
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def measure_slice(s: Slice, window: int, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    n = len(s.off) - 1
    is_word = ~WHITE[s.data]
    starts, ends = word_bounds(is_word)
    chars = np.concatenate([[0], np.cumsum((s.data & 0xC0) != 0x80)])
    wchars = chars[ends] - chars[starts]
    woff = np.searchsorted(starts, s.off)
    per_text = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[woff])
    text = np.repeat(np.arange(n, dtype=np.uint64), np.diff(woff))
    out = {"n_words": np.diff(woff), "word_chars": per_text(wchars),
           "n_symbols": counts_between(np.flatnonzero(SYMBOLS[s.data]), s.off)}

    rolling = RollingHash(_BYTES[s.data], _BY_BYTE)
    words = mixed(rolling.of(starts, ends))

    le = np.flatnonzero(s.data == 10)
    ls = np.concatenate([[0], le[:-1] + 1]) if len(le) else le
    fw, lw = np.searchsorted(starts, ls), np.searchsorted(starts, le)
    full = lw > fw
    ls, le, fw, lw = ls[full], le[full], fw[full], lw[full]
    ltext = np.searchsorted(s.off, ls, side="right") - 1
    lkey = mixed(rolling.of(ls, le) + mixed((le - ls).astype(np.uint64) + (ltext.astype(np.uint64) << np.uint64(32))))
    order = np.argsort(lkey, kind="stable")
    again = np.zeros(len(lkey), dtype=bool)
    again[order[1:]] = lkey[order[1:]] == lkey[order[:-1]]
    out["n_dup_lines"] = np.bincount(ltext[again], minlength=n)
    wsum = np.concatenate([[0], np.cumsum(wchars)])
    out["dup_line_chars"] = np.bincount(ltext[again], weights=(wsum[lw] - wsum[fw])[again], minlength=n).astype(np.int64)

    grams = RollingHash(words, _BY_WORD)
    at = np.arange(len(words))
    for k in sorted({window, *lengths}):
        at = at[at + k <= len(words)]
        at = at[text[at] == text[at + k - 1]]
        dup = repeated(mixed(grams.of(at, at + k) + mixed(text[at])))
        at = at[dup]  # a longer repeated window starts with a shorter one
        step = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(step, at, 1)
        np.add.at(step, at + k, -1)
        inside = np.cumsum(step[:-1]) > 0
        if k == window:
            out["n_repeat_words"] = per_text(inside)
        if k in lengths:
            out[f"in_{k}"] = per_text(wchars * inside)
    return {k: v.astype(np.int64) for k, v in out.items()}


def measures(window: int = 5, lengths: tuple[int, ...] = (4, 6, 8, 10)):
    """Arrow UDF: text -> struct of counts. n_words, word_chars (code points in words), n_symbols,
    n_dup_lines, dup_line_chars, n_repeat_words and in_<n>: code points of words inside repeated n-grams."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "dup_line_chars", "n_repeat_words", *[f"in_{k}" for k in lengths]]

    @F.arrow_udf(", ".join(f"{n} long" for n in names))
    def measure(texts: pa.Array) -> pa.Array:
        parts = [measure_slice(s, window, lengths) for s in slices(texts)]
        return pa.StructArray.from_arrays([pa.array(np.concatenate([p[n] for p in parts]) if parts else np.zeros(0, np.int64)) for n in names], names)

    return measure


def base_failed(m: Column, limits: Limits) -> Column:
    return (m["n_words"] < limits.min_words) | (100 * m["n_repeat_words"] > limits.repeat_pct * m["n_words"])


def passed(m: Column, limits: Limits) -> Column:
    ok = (m["dup_line_chars"] <= limits.line_chars * m["word_chars"]) & (m["n_symbols"] <= limits.symbols * m["n_words"])
    for k, share in sorted(limits.coverage.items()):
        ok &= m[f"in_{k}"] <= share * m["word_chars"]
    return ok & ~base_failed(m, limits)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """One row per document with the measures, base_failed and kept.

    Null and empty texts have no words: all counts 0, base_failed. Repeated rows are judged one by one; a null
    id is kept as it is; other columns are not read. Memory of a task is about 60 bytes per byte of one slice
    (1 MB, or one longer text). No shuffle.
    """
    m = measures(limits.window, tuple(limits.coverage))(F.col(text_col))
    d = docs.select(F.col(id_col), m.alias("m"))
    m = F.col("m")
    return d.select(id_col, "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words",
                    base_failed(m, limits).alias("base_failed"), passed(m, limits).alias("kept"),
                    "m.dup_line_chars", *[f"m.in_{k}" for k in limits.coverage])


def keep_good(docs: DataFrame, text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    m = measures(limits.window, tuple(limits.coverage))(F.col(text_col))
    d = docs.select(F.struct("*").alias("row"), m.alias("m"))
    return d.where(passed(F.col("m"), limits)).select("row.*")
