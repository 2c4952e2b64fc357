"""Periodic runs against a walk over every period."""
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from helpers import docs, rows, same

from barlab.llm import periodic, queries


def plain_runs(w):
    """(start, end, smallest period) of all runs: for every period the stretches in which words that far apart agree."""
    out = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j - i >= p:
                out.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((a, b, p) for (a, b), p in out.items())


def sequences():
    rnd = random.Random(1)
    yield from ([], [1], [1, 1], [1] * 50)
    for _ in range(150):
        yield [rnd.randrange(rnd.choice([1, 2, 2, 3, 5])) for _ in range(rnd.randint(0, 100))]
    fib, more = [0], [0, 1]
    for _ in range(9):
        fib, more = more, more + fib
    yield more
    thue = [0]
    for _ in range(8):
        thue += [1 - x for x in thue]
    yield thue
    for _ in range(60):
        u = [rnd.randrange(3) for _ in range(rnd.randint(1, 40))]
        yield [rnd.randrange(9) for _ in range(rnd.randint(0, 30))] + u * rnd.randint(2, 6) + u[:rnd.randint(0, len(u))] + [7, 8]


@pytest.mark.parametrize("batch", [None, 1, 7, 64])
def test_runs_in_batches_of_any_size(batch):
    for w in sequences():
        if batch == 1 and len(w) > 120:
            continue
        got = periodic.runs_of(periodic.mixed(np.array(w, dtype=np.uint64) + np.uint64(5)), batch=batch)
        assert sorted(zip(*(x.tolist() for x in got))) == plain_runs(w)


def test_thue_morse_words_hold_no_long_power():
    t = [0]
    for _ in range(12):
        t += [1 - x for x in t]
    a, b, q = periodic.runs_of(periodic.mixed(np.array(t, dtype=np.uint64)))
    assert len(a) and (b - a <= 2 * q).all()              # overlap-free: a hash by powers would err here
    t = np.array(t)
    assert all((t[x:y - p] == t[x + p:y]).all() for x, y, p in zip(a[::50], b[::50], q[::50]))


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = sorted(((a, b - a, q) for a, b, q in plain_runs(w) if b - a >= max(12, 2 * q)), key=lambda r: (r[0], r[2]))
    gone = {i for a, k, q in runs for i in range(a + q, a + k)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % r for r in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def made(seed):
    rnd = random.Random(seed)
    u = " ".join(rnd.choice("ab cd é ß 日本 x".split()) for _ in range(rnd.randint(1, 9)))
    return " \n".join([u] * rnd.randint(1, 9)) + "\t" + " ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 40))) + rnd.choice(["", " ", " x y z", "\x01 \x00"])


def test_report_on_texts_of_all_kinds(spark):
    rs = rows(21) + [(1000 + i, made(i), "en", "s") for i in range(150)] + [(5000, "a b " * 3000 + "c", "en", "s"), (5001, "a b " * 3000 + "c", "en", "s"), (None, made(3) * 4, "en", "s")]
    d = docs(spark, rs)
    got = periodic.report(d).collect()
    want = [expected(i, t) for i, t, _, _ in rs]
    same(got, want)
    assert sum(w[1] > 0 for w in want) > 30 and sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rs) > 5
    assert periodic.report(d.limit(0)).count() == 0
    whole = periodic.with_runs(d.withColumn("r", d.doc_id)).select("row.*")
    assert whole.columns == [*d.columns, "r"] and whole.count() == len(rs)


def test_one_very_long_text(spark):
    rnd = random.Random(2)
    w = [str(rnd.randrange(5000)) for _ in range(400_000)]
    w[100_000:160_000] = w[100_000:120_000] * 3
    w[300_000:300_040] = ["z"] * 40
    got = periodic.with_runs(docs(spark, [(1, " ".join(w), "en", "s")])).select("r.*").first()
    assert [(r.start, r.length, r.period) for r in got.runs] == [(100_000, 60_000, 20_000), (300_000, 40, 1)] and got.n_words == len(w)
    assert got.collapsed == " ".join(w[:120_000] + w[160_000:300_001] + w[300_040:])


def test_query_over_its_table(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.QUERIES["op13_periodic_runs"](spark, sf).collect()
    short = [r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() if len((r.text or "").split()) < 600]
    ids = {r.doc_id for r in short}
    same([r for r in got if r.doc_id in ids], [expected(r.doc_id, r.text) for r in short])
