"""Plain versions of the operators, one text at a time, for comparison."""
import hashlib
import re

import xxhash

WS = "[^\x20\x09-\x0d]+"
LOWER = {c: c + 32 for c in range(65, 91)}


def contamination(text, items, window=13):
    """n_words, n_hit, item ids, contaminated."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    w = words(text)
    hit, ids = set(), set()
    for i, t in items:
        v = words(t)
        n = min(window, len(v))
        wins = {tuple(v[j:j + n]) for j in range(len(v) - n + 1)} if n else set()
        for j in range(len(w) - n + 1):
            if n and tuple(w[j:j + n]) in wins:
                hit.update(range(j, j + n))
                ids.add(str(i))
    return len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)


def quality(text, limits):
    t = text or ""
    w = re.findall(WS, t)

    def inside(k):
        at = {}
        for i in range(len(w) - k + 1):
            at.setdefault(tuple(w[i:i + k]), []).append(i)
        return {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + k)}

    seen, dup, dup_chars = set(), 0, 0
    for line in t.split("\n"):
        if re.search(WS, line):
            if line in seen:
                dup += 1
                dup_chars += sum(map(len, re.findall(WS, line)))
            seen.add(line)
    chars = sum(map(len, w))
    out = {"n_words": len(w), "word_chars": chars, "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": dup,
           "n_repeat_words": len(inside(limits.window)), "dup_line_chars": dup_chars}
    out["base_failed"] = len(w) < limits.min_words or 100 * out["n_repeat_words"] > limits.repeat_pct * len(w)
    kept = not out["base_failed"] and dup_chars <= limits.line_chars * chars and out["n_symbols"] <= limits.symbols * len(w)
    for k, share in limits.coverage.items():
        out[f"in_{k}"] = sum(len(w[p]) for p in inside(k))
        kept = kept and out[f"in_{k}"] <= share * chars
    out["kept"] = kept
    return out


def digits(v):
    return re.sub("[^0-9]", "", v)


def luhn(v):
    total = 0
    for i, c in enumerate(reversed(v)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def personal(text):
    t, out = text or "", []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = digits(m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                  "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def secrets(text):
    t, out = text or "", []
    p = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(p, t, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return [x[2] for x in sorted(out)]


def fingerprint(text, n=4):
    w = re.findall(WS, (text or "").translate(LOWER))
    sh = [" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    out = 0
    for b in range(64):
        if 2 * sum(h >> b & 1 for h in hs) > len(hs):
            out |= 1 << b
    return out


def roots(n, linked):
    p = list(range(n))

    def top(v):
        while p[v] != v:
            v = p[v]
        return v
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = top(i), top(j)
                p[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def simhash_components(rows):
    """(doc_id, text) -> list of (fingerprint, component id), ids may be None."""
    f = [fingerprint(t) for _, t in rows]
    r = roots(len(rows), lambda i, j: (f[i] ^ f[j]).bit_count() <= 4)
    low = {}
    for (i, _), k in zip(rows, r):
        if i is not None:
            low[k] = min(low.get(k, i), i)
    return [(x, low.get(k)) for x, k in zip(f, r)]


def strip_lines(rows, min_sites=10, long_sites=3, long_chars=250, min_left=0.1):
    """(site, text) -> list of (text, n_lines, n_cut, spared)."""
    sites = {}
    for site, t in rows:
        for line in ([] if t is None else t.split("\n")):
            if line.strip(" \t\r"):
                sites.setdefault(line.strip(" \t\r"), set()).add(site or "")
    need = max(2, min(min_sites, (len({s for v in sites.values() for s in v}) + 1) // 2))
    wide = {k for k, v in sites.items() if len(v) >= (min(need, long_sites) if len(k) >= long_chars else need)}
    out = []
    for _, t in rows:
        if t is None:
            out.append((None, 0, 0, False))
            continue
        every = t.split("\n")
        left = [x for x in every if x.strip(" \t\r") not in wide]
        if len(left) == len(every):
            out.append((t, len(every), 0, False))
        elif sum(map(len, left)) < min_left * sum(map(len, every)):
            out.append((t, len(every), 0, True))
        else:
            out.append(("\n".join(left), len(every), len(every) - len(left), False))
    return out


def best_fit(items, capacity):
    """(length, source, cluster) in order -> (bin, start); every open bin is looked at."""
    bins, out = [], []
    for n, s, c in items:
        fit = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= n and (s is None or s not in b["s"]) and (c is None or c not in b["c"])]
        if fit:
            k = min(fit)[1]
        else:
            bins.append({"left": capacity, "s": set(), "c": set()})
            k = len(bins) - 1
        b = bins[k]
        out.append((k, capacity - b["left"]))
        b["left"] -= n
        b["s"].add(s)
        b["c"].add(c)
    return out


def sha(items):
    return hashlib.sha256(",".join(items).encode()).hexdigest()
