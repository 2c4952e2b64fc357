"""Ranked lexical search against scoring every document."""
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import docs, prose, rows, same

from barlab.llm import lexical


def plain(rs, items, k):
    """Scores of all documents for all items, by the definition."""
    terms = lambda s: [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", s or "")]
    bags = [(i, Counter(terms(t))) for i, t in rs]
    total, length = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            s = 0
            for t in set(terms(text)) & set(b):
                m = 50 + 50 * sum(b.values()) * total // length
                s += math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 20 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return out


def items(seed):
    rnd = random.Random(seed)
    out = [(i, prose(rnd, rnd.choice([1, 3, 8, 20, 60]))) for i in range(10)]
    return [*out, (20, None), (21, " .. "), (22, "nowhere zzz"), (23, "The THE the É é 42"), (3, out[5][1]), (None, "lorem"), (24, out[2][1])]


@pytest.mark.parametrize("block_bytes", [1 << 20, 100])
def test_ranks(spark, block_bytes):
    rs = rows(31, 120)
    rs += [(2000 + i, "lorem ipsum x", "en", "s") for i in range(70)] + [(None, "lorem ipsum x", "en", "s"), (2001, "lorem ipsum x", "en", "s"), (9, "ipsum " * 30000 + "dolor", "en", "s")]
    its = items(4)
    got = lexical.search(docs(spark, rs).repartition(5), spark.createDataFrame(its, "item_id long, text string"), k=50, block_bytes=block_bytes).collect()
    same(got, plain([(i, t) for i, t, _, _ in rs], its, 50))
    assert len({r.item_id for r in got}) > 10


def test_empty_tables(spark):
    d, b = docs(spark, rows(32)), spark.createDataFrame(items(4), "item_id long, text string")
    assert lexical.search(d.limit(0), b).count() == 0
    assert lexical.search(d, b.limit(0)).count() == 0
    assert lexical.search(d, b.where("item_id in (20, 21, 22)")).count() == 0


def table(vectors, ids):
    off = np.concatenate([[0], np.cumsum([len(v) for v in vectors])])
    flat = [x for v in vectors for x in sorted(v.items())]
    return pa.record_batch([pa.array(ids), pa.array([sum(v.values()) for v in vectors], pa.int64()),
                            pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array([t for t, _ in flat], pa.int32())),
                            pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array([c for _, c in flat], pa.int32()))], ["id", "n", "term", "tf"])


@pytest.mark.parametrize("entries", [1, 40, 10_000])
def test_blocks_of_any_size_with_ties(entries):
    rnd = random.Random(entries)
    for _ in range(20):
        n_terms, n_docs = rnd.randint(1, 12), rnd.randint(1, 80)
        vectors = [{rnd.randrange(n_terms): rnd.randint(1, 3) for _ in range(rnd.randint(0, 5))} for _ in range(n_docs)]
        ids = list(range(n_docs))
        rnd.shuffle(ids)
        w = lexical.weights(np.array([sum(t in v for v in vectors) for t in range(n_terms)]), sum(map(bool, vectors)), sum(sum(v.values()) for v in vectors))
        queries = [np.array(sorted(rnd.sample(range(n_terms), rnd.randint(1, n_terms)))) for _ in range(5)]
        batch = table(vectors, ids)
        cut = rnd.randint(0, n_docs)
        got = pa.Table.from_batches(list(lexical.ranker(queries, w, 6, entries)(iter([batch.slice(0, cut), batch.slice(cut)]))) or [table([], []).select(["id"])]).to_pylist()
        want = []
        for q, terms in enumerate(queries):
            scored = sorted((-sum(int(w.contribution(np.array([t]), np.array([v[t]]), np.array([sum(v.values())]))[0]) for t in terms.tolist() if t in v), i) for v, i in zip(vectors, ids))
            want += [(q, i, -s) for s, i in [x for x in scored if x[0] < 0][:6]]
        assert [(r["query"], r["id"], r["score"]) for r in got] == want


def test_reading_stops_at_best_positions():
    """A few documents hold rare terms; of the many that hold the frequent one only some are scored."""
    vectors = [{0: 1 + i % 3, **({1: 5, 2: 5} if i % 500 == 0 else {})} for i in range(10_000)]
    off = np.concatenate([[0], np.cumsum([len(v) for v in vectors])])
    n = np.array([sum(v.values()) for v in vectors]) + 50
    w = lexical.weights(np.array([5000, 20, 20]), 10_000, int(n.sum()))
    term, tf = (np.array([x for v in vectors for x in col(v)]) for col in (dict.keys, dict.values))
    block = lexical.Block(off, term, tf, n, np.arange(10_000), np.zeros(10_000, bool), w)
    best = lexical.Best(10)
    assert block.search(np.array([0, 1, 2]), best) < 200
    assert best.id.tolist() == sorted(best.id.tolist(), key=lambda i: (-best.score[best.id.tolist().index(i)], i)) and (best.id % 500 == 0).all()
    again = lexical.Best(10)
    block.search(np.array([0, 1, 2]), again)
    assert again.id.tolist() == best.id.tolist() and not block.seen.any() and not block.scored.any() and not block.member.any()


def test_terms_with_one_hash_differ_by_bytes():
    v = lexical.Vocabulary(["ab", "cd"])
    v.sorted[:] = v.sorted[0]                             # as if both had one hash
    data = np.frombuffer(b"ab cd ab\n", dtype=np.uint8)
    at, term = v.find(data, np.array([0, 3, 6]), np.array([2, 5, 8]))
    assert all(bytes(data[[0, 3, 6][i]:][:2]) == [b"ab", b"cd"][t] for i, t in zip(at, term))
