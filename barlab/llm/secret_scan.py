"""Secrets: fixed patterns, and sliding-window Shannon entropy over candidate strings.

A candidate is a long run of characters that keys are made of. Its character class (hexadecimal, or letters and
digits with signs) sets the threshold; the entropy of a window moving over it follows from the counts of the one
character that enters and the one that leaves. An allow-list suppresses strings that look random but are no secrets.
"""
from __future__ import annotations

import re
from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .textbytes import slices, word_bounds

KINDS = ("assign", "access", "hex")
_ANY = lambda s: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in s)
_NAMES = "|".join(_ANY(s) for s in ("password", "passwd", "secret", "token")) + "|" + _ANY("api") + "_?" + _ANY("key")
ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are matched whole, shorter ones would be dropped
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_RUN_BYTES = np.array([chr(b) in "+/_=-" or (b < 128 and chr(b).isalnum()) for b in range(256)])
_HINT = "password|passwd|secret|token|api_?key|akia"


@dataclass(frozen=True)
class Entropy:
    """Bits per character that the best window must reach, by class; the window is as long as the shortest candidate."""
    window: int = 20
    hexadecimal: float = 3.1
    mixed: float = 3.75
    allow: tuple[str, ...] = (
        r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUIDs
        r"[0-9_=+/-]+",                                           # numbers, dates, rulers
        r"[A-Za-z_=+/-]+",                                        # words without a digit: identifiers, paths
        r"(?i:.*(?:example|placeholder|changeme|dummy|sample|your[_-]).*)",
    )


def best_entropy(s: str, w: int) -> float:
    """Largest Shannon entropy of a window of ``w`` characters."""
    term = [0.0] + [c * log2(c) for c in range(1, w + 1)]
    n: dict[str, int] = {}
    total = best = 0.0
    for i, c in enumerate(s):
        k = n.get(c, 0)
        n[c] = k + 1
        total += term[k + 1] - term[k]
        if i >= w:
            d = s[i - w]
            k = n[d]
            n[d] = k - 1
            total += term[k - 1] - term[k]
        if i >= w - 1:
            best = max(best, log2(w) - total / w)
    return best


def scan(text: str, how: Entropy, allow: list[re.Pattern]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and added spans as (start, end, kind)."""
    base = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    base += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    base += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    base.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    ends, far = [], 0
    for _, e, _ in base:
        far = max(far, e)
        ends.append(far)
    more, j = [], 0
    for m in RUN.finditer(text):
        s = m[0]
        while j < len(base) and base[j][0] < m.end():
            j += 1
        if j and ends[j - 1] > m.start():  # overlaps a base span
            continue
        if any(p.fullmatch(s) for p in allow):
            continue
        limit = how.hexadecimal if re.fullmatch(r"[0-9a-fA-F]+", s) else how.mixed
        if best_entropy(s, how.window) >= limit:
            more.append((m.start(), m.end(), "entropy"))
    return base, more


_NAMES_OUT = ["n_assign", "n_access", "n_hex", "base", "spans"]
_TYPES = [pa.int64()] * 3 + [pa.list_(pa.string())] * 2


def scanner(how: Entropy):
    @F.arrow_udf("n_assign long, n_access long, n_hex long, base array<string>, spans array<string>")
    def run(texts: pa.Array) -> pa.Array:
        allow = [re.compile(p) for p in how.allow]
        texts = pc.fill_null(texts, "")
        look = np.array(pc.match_substring_regex(texts, _HINT, ignore_case=True).to_pylist(), dtype=bool)
        for s in slices(texts):  # texts with a run as long as a window
            a, b = word_bounds(_RUN_BYTES[s.data])
            long = a[b - a >= how.window]
            look[s.first + np.unique(np.searchsorted(s.off, long, side="right") - 1)] = True
        n, base, spans = np.zeros((3, len(texts)), dtype=np.int64), [[]] * len(texts), [[]] * len(texts)
        order = {k: i for i, k in enumerate((*KINDS, "entropy"))}
        name = lambda x: f"{x[2]}:{x[0]}:{x[1]}"
        for i in np.flatnonzero(look).tolist():
            b, more = scan(texts[i].as_py(), how, allow)
            for x in b:
                n[order[x[2]], i] += 1
            base[i] = [name(x) for x in b]
            spans[i] = [name(x) for x in sorted(b + more, key=lambda x: (x[0], order[x[2]]))]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip([*n, base, spans], _TYPES)], _NAMES_OUT)
    return run


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Entropy = Entropy()) -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base and spans (arrays of kind:start:end, code points).

    Null texts are empty; repeated rows and null ids stay; other columns are not read. Spans found by entropy have
    the kind 'entropy', never overlap a base span and sort after the others at one start. No shuffle.
    """
    return docs.select(F.col(id_col), scanner(how)(F.col(text_col)).alias("m")).select(id_col, *[f"m.{c}" for c in _NAMES_OUT])
