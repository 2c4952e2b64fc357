"""Token counts of a byte-pair vocabulary with word ends: all pre-tokens of a batch are merged together.

Distinct pre-tokens lie in one flat array of symbols. Each round looks up the rank of every neighbouring pair,
takes the lowest rank in each sequence and joins that pair at once wherever it occurs in the sequence; the
symbols that survive are the tokens.
"""
from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from .textbytes import WHITE, Powers, RollingHash, mixed, slices, word_bounds

NONE = np.int64(1 << 40)


class WordBpe:
    """Vocabulary file of the ``tokenizers`` library: NFC, white space to spaces, lower case, split by a
    pattern of which the matches stay, bytes as symbols, merges by rank, a suffix on the last symbol. Letters
    added by the newest Unicode version may be split otherwise than in the library, whose tables are older."""

    def __init__(self, path: str, bits: int = 21):
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        model = conf["model"]
        vocab: dict[str, int] = model["vocab"]
        letters, suffix = _byte_letters(), model["end_of_word_suffix"] or ""
        self.inner = np.array([vocab.get(c, -1) for c in letters], dtype=np.int64)
        self.final = np.array([vocab.get(c + suffix, -1) for c in letters], dtype=np.int64)
        steps = conf["pre_tokenizer"]["pretokenizers"]
        self.split = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(conf["added_tokens"], key=lambda t: -len(t["content"]))))
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.width = np.int64(max(vocab.values()) + 1)
        self._fill(left * self.width + right)
        # A join may give a pair of lower rank only if its symbol stands in an earlier merge. Such ranks are
        # applied at one place per round, all others everywhere at once: the outcome is that of one by one.
        earliest = np.full(int(self.width), NONE)
        np.minimum.at(earliest, left, np.arange(len(left)))
        np.minimum.at(earliest, right, np.arange(len(right)))
        self.single = earliest[self.made] < np.arange(len(self.made))
        self.known = Remembered(bits)

    def _fill(self, keys: np.ndarray) -> None:
        """Open addressing: pair -> rank. The last rank of a pair listed twice counts."""
        self.bits = max(4, int(2 * len(keys)).bit_length() + 1)
        self.key_at = np.full(1 << self.bits, -1, dtype=np.int64)
        self.rank_at = np.full(1 << self.bits, NONE)
        self.probes = 1
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.key_at[at] < 0
            self.key_at[at[free]] = keys[left[free]]
            held = self.key_at[at] == keys[left]
            np.maximum.at(rank := np.full(1 << self.bits, -1), at[held], left[held])
            got = rank >= 0
            self.rank_at[got] = np.where(self.rank_at[got] == NONE, rank[got], np.maximum(self.rank_at[got], rank[got]))
            left, at = left[~held], (at[~held] + 1) & ((1 << self.bits) - 1)
            self.probes += len(left) > 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = self._slot(key)
        held = self.key_at[at]
        out = np.where(held == key, self.rank_at[at], NONE)
        for _ in range(self.probes - 1):
            more = np.flatnonzero((held != key) & (held >= 0))
            if not len(more):
                break
            at[more] = (at[more] + 1) & ((1 << self.bits) - 1)
            held[more] = self.key_at[at[more]]
            out[more] = np.where(held[more] == key[more], self.rank_at[at[more]], NONE)
        return out

    def count_words(self, words: list[str]) -> np.ndarray:
        """Tokens of each (non-empty) pre-token. Symbols outside the vocabulary vanish: there is no unknown token."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        seq = np.repeat(np.arange(len(raw), dtype=np.int64), size)
        sym = self.inner[data]
        last = np.cumsum(size) - 1
        sym[last] = self.final[data[last]]
        known = sym >= 0
        sym, seq = sym[known], seq[known]
        out = np.bincount(seq, minlength=len(raw))
        rank = None
        while len(sym):  # also for one last symbol, of a sequence that joined as a whole
            if rank is None:
                rank = np.full(len(sym), NONE)
                rank[:-1] = np.where(seq[:-1] == seq[1:], self.rank_of(sym[:-1], sym[1:]), NONE)
            first = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            size = np.diff(np.append(first, len(seq)))
            low = np.minimum.reduceat(rank, first)
            done = low == NONE
            if done.any():  # finished sequences leave the arrays
                out[seq[first[done]]] = size[done]
                stay = np.repeat(~done, size)
                sym, seq, rank, low, size = sym[stay], seq[stay], rank[stay], low[~done], size[~done]
                if not len(sym):
                    break
            own = np.repeat(low, size)
            at = np.flatnonzero(rank == own)
            group = seq[at]
            # in a run of overlapping places every other one is taken, from the left
            new_run = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (group[1:] != group[:-1])])
            start = np.maximum.accumulate(np.where(new_run, at, 0))
            lead = np.concatenate([[True], group[1:] != group[:-1]])
            at = at[((at - start) % 2 == 0) & (lead | ~self.single[own[at]])]
            sym[at] = self.made[own[at]]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            new = (np.cumsum(keep) - 1)[at]
            sym, seq, rank = sym[keep], seq[keep], rank[keep]
            beside = np.zeros(len(sym), dtype=bool)  # only pairs beside a join change
            beside[new] = True
            beside[np.maximum(new - 1, 0)] = True
            near = np.flatnonzero(beside[:-1])
            rank[near] = np.where(seq[near] == seq[near + 1], self.rank_of(sym[near], sym[near + 1]), NONE)
            rank[-1] = NONE
        return out

    def pre_tokens(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return self.split.findall(_lower(text))

    def count_chunks(self, chunks: list[str]) -> np.ndarray:
        """Tokens of each chunk; special strings inside are one token each."""
        fixed, words, owner = np.zeros(len(chunks), dtype=np.int64), [], []
        for i, c in enumerate(chunks):
            parts = [c]
            if "<|" in c:
                fixed[i] = len(self.special.findall(c))
                parts = self.special.split(c)
            for p in parts:
                w = self.pre_tokens(p)
                words += w
                owner += [i] * len(w)
        if words:
            np.add.at(fixed, np.array(owner), self.count_words(words))
        return fixed

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text. Pre-tokens never hold white space, so a text is the sum over its chunks, the pieces
        between ASCII white space. Chunks are told apart by hash and length; counts of short ones are remembered."""
        out = [np.zeros(0, dtype=np.int64)]
        for s in slices(texts):
            starts, ends = word_bounds(~WHITE[s.data])
            size = ends - starts
            key = mixed(RollingHash(s.data.astype(np.uint64) + np.uint64(1), _BYTES).of(starts, ends) + size.astype(np.uint64))
            n = self.known.get(key)
            lost = np.flatnonzero(n < 0)
            if len(lost):
                new, first, which = np.unique(key[lost], return_index=True, return_inverse=True)
                rows = lost[first]
                got = self.count_chunks([s.data[a:b].tobytes().decode() for a, b in zip(starts[rows].tolist(), ends[rows].tolist())])
                n[lost] = got[which]
                short = size[rows] <= SHORT
                self.known.put(new[short], got[short])
            sums = np.concatenate([[0], np.cumsum(n)])
            out.append(np.diff(sums[np.searchsorted(starts, s.off)]))
        return np.concatenate(out)


_BYTES = Powers(0x9E3779B97F4A7C15)
# Chunks of more bytes are counted anew each time.
SHORT = 64


class Remembered:
    """Counts by 64-bit key in a table of fixed size: a key has two places, a newer one takes the second."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.key = np.zeros(1 << bits, dtype=np.uint64)
        self.n = np.full(1 << bits, -1, dtype=np.int32)

    def _places(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = (key >> self.shift).astype(np.int64)
        return a, a ^ 1

    def get(self, key: np.ndarray) -> np.ndarray:
        """Counts, -1 where unknown."""
        a, b = self._places(key)
        out = np.where(self.key[a] == key, self.n[a], np.int32(-1)).astype(np.int64)
        rest = np.flatnonzero(out < 0)
        out[rest] = np.where(self.key[b[rest]] == key[rest], self.n[b[rest]], -1)
        return out

    def put(self, key: np.ndarray, n: np.ndarray) -> None:
        a, b = self._places(key)
        at = np.where(self.n[a] < 0, a, b)
        self.key[at], self.n[at] = key, n


def _lower(text: str) -> str:
    """Lower case of each code point alone: a capital sigma at a word's end has no form of its own."""
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


def _byte_letters() -> list[str]:
    """A printable character for every byte: those that print stand for themselves, the rest follow from 256 on."""
    out, n = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out.append(chr(b))
        else:
            out.append(chr(n))
            n += 1
    return out


_MODELS: dict[str, WordBpe] = {}


def model(path: str) -> WordBpe:
    """One per worker and file."""
    if path not in _MODELS:
        _MODELS[path] = WordBpe(path)
    return _MODELS[path]


def counter(path: str):
    """Arrow UDF: text -> tokens. ``path`` must be readable where tasks run, as an installed package is."""
    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(model(path).count(texts))

    return count


def over(n: Column, limit: int) -> Column:
    return n > limit


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per document: n_bytes, n_tokens, over_limit.

    Counts are those of the library without added, begin or end tokens; special strings inside a text are one
    token each, as is its default. Null and empty texts count 0; repeated rows and null ids stay as they are;
    other columns are not read. A worker remembers words of up to 64 bytes in a table of 25 MB; longer ones are counted anew. No shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), counter(path)(F.col(text_col)).alias("n_tokens"))
            .withColumn("over_limit", over(F.col("n_tokens"), limit)))
