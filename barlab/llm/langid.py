"""Language identification with a bidirectional gated recurrent network over bytes.

Texts are cut in windows of bytes; one network reads each window forwards, one backwards, every position gets a
probability for each language from both states, and a document's probabilities are the mean over all its positions.
The network is trained in numpy by backpropagation through time. Gates use x / (1 + |x|), which costs a division
where the logistic function costs an exponential.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .sampling import lowest
from .textbytes import slices

UNDETERMINED = "und"


@dataclass(frozen=True)
class Setup:
    """``rows`` bounds the training sample (different texts, those of lowest hash in each language), ``stretches`` the windows taken
    from each of them."""
    hidden: int = 8
    window: int = 128
    rows: int = 1024
    stretches: int = 4
    train_window: int = 64
    epochs: int = 12
    batch: int = 128
    rate: float = 0.02
    seed: int = 7


def soft(x: np.ndarray) -> np.ndarray:
    d = np.abs(x)
    d += 1
    x /= d
    return x


class Direction:
    """Gated recurrent units over bytes, feature-major: input table (3H x 256), gate matrix (2H x H), candidate
    matrix (H x H). A gate is (1 + soft) / 2."""
    NAMES = ("table", "gates", "cand")

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.h = hidden
        self.table = rng.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32)
        self.gates = rng.normal(0, 0.3, (2 * hidden, hidden)).astype(np.float32)
        self.cand = rng.normal(0, 0.3, (hidden, hidden)).astype(np.float32)

    def run(self, x: np.ndarray) -> np.ndarray:
        """States (T, H, B) for bytes (T, B)."""
        h_, b = self.h, x.shape[1]
        out = np.empty((len(x), h_, b), dtype=np.float32)
        h = np.zeros((h_, b), dtype=np.float32)
        g, zr, d = np.empty((3 * h_, b), np.float32), np.empty((2 * h_, b), np.float32), np.empty((2 * h_, b), np.float32)
        c = np.empty((h_, b), np.float32)
        half = self.cand * np.float32(0.5)
        for t in range(len(x)):
            np.take(self.table, x[t], axis=1, out=g, mode="clip")
            np.matmul(self.gates, h, out=zr)
            zr += g[:2 * h_]
            np.abs(zr, out=d)
            d += 1
            zr /= d
            zr += 1                        # twice the gates
            np.multiply(zr[h_:], h, out=d[:h_])
            np.matmul(half, d[:h_], out=c)
            c += g[2 * h_:]
            np.abs(c, out=d[:h_])
            d[:h_] += 1
            c /= d[:h_]
            c -= h
            c *= zr[:h_]
            c *= 0.5
            np.add(h, c, out=out[t])
            h = out[t]
        return out

    def forward(self, x: np.ndarray):
        """As run, keeping what the way back needs."""
        h_ = self.h
        h, trace, out = np.zeros((h_, x.shape[1]), np.float32), [], []
        for t in range(len(x)):
            g = self.table[:, x[t]]
            zr = (soft(self.gates @ h + g[:2 * h_]) + 1) * np.float32(0.5)
            rh = zr[h_:] * h
            c = soft(self.cand @ rh + g[2 * h_:])
            trace.append((h, zr, rh, c))
            h = h + zr[:h_] * (c - h)
            out.append(h)
        return np.stack(out), trace

    def backward(self, x: np.ndarray, trace, grad: np.ndarray) -> list[np.ndarray]:
        """Gradients of table, gates and cand for the gradients of all states."""
        h_ = self.h
        dt, dg, dc = (np.zeros_like(m) for m in (self.table, self.gates, self.cand))
        back = np.zeros_like(grad[0])
        pre = np.empty((3 * h_, len(x), x.shape[1]), np.float32)
        for t in range(len(x) - 1, -1, -1):
            h, zr, rh, c = trace[t]
            z, r = zr[:h_], zr[h_:]
            d = grad[t] + back
            back = d * (1 - z)
            ds = (d * z) * (1 - np.abs(c)) ** 2
            dc += ds @ rh.T
            drh = self.cand.T @ ds
            back += drh * r
            dgate = np.concatenate([d * (c - h), drh * h]) * (0.5 * (1 - np.abs(2 * zr - 1)) ** 2)
            dg += dgate @ h.T
            back += self.gates.T @ dgate
            pre[:2 * h_, t], pre[2 * h_:, t] = dgate, ds
        flat = x.ravel()
        for k in range(3 * h_):
            dt[k] = np.bincount(flat, weights=pre[k].ravel(), minlength=256)
        return [dt, dg, dc]


class Network:
    def __init__(self, langs: list[str], how: Setup):
        rng = np.random.default_rng(how.seed)
        self.langs, self.how = langs, how
        self.ahead, self.back = Direction(how.hidden, rng), Direction(how.hidden, rng)
        self.out = rng.normal(0, 0.3, (len(langs), 2 * how.hidden)).astype(np.float32)
        self.bias = np.zeros((len(langs), 1), dtype=np.float32)

    def _probabilities(self, f: np.ndarray, b: np.ndarray) -> np.ndarray:
        """(T, K, B) from the states of both directions."""
        h = self.how.hidden
        p = np.matmul(self.out[:, :h], f)
        p += np.matmul(self.out[:, h:], b)
        p += self.bias
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def train(self, x: np.ndarray, y: np.ndarray) -> None:
        """x: (T, N) bytes, y: languages. Every position of a window has the window's language; classes weigh alike."""
        how, rng = self.how, np.random.default_rng(self.how.seed + 1)
        weight = (1 / np.maximum(np.bincount(y, minlength=len(self.langs)), 1))[y]
        weight = (weight / weight.mean()).astype(np.float32)
        params = [getattr(d, n) for d in (self.ahead, self.back) for n in Direction.NAMES] + [self.out, self.bias]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        steps = how.epochs * -(-len(y) // how.batch)
        for _ in range(how.epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), how.batch):
                at = order[i:i + how.batch]
                xb, rb = x[:, at], x[::-1, at]
                f, ft = self.ahead.forward(xb)
                b, bt = self.back.forward(rb)
                b = b[::-1]
                d = self._probabilities(f, b)
                d[:, y[at], np.arange(len(at))] -= 1
                d *= weight[at] / (len(x) * len(at))
                h = how.hidden
                g_out = np.concatenate([np.einsum("tkb,thb->kh", d, s, optimize=True) for s in (f, b)], axis=1)
                grads = self.ahead.backward(xb, ft, np.matmul(self.out[:, :h].T, d))
                grads += self.back.backward(rb, bt, np.matmul(self.out[:, h:].T, d)[::-1])
                grads += [g_out, d.sum(axis=(0, 2))[:, None]]
                size = np.sqrt(sum(float((g * g).sum()) for g in grads))
                step += 1
                rate = how.rate * (1 - step / (steps + 1))
                for p, g, m, v in zip(params, grads, first, second):
                    g = g * min(1.0, 1.0 / max(size, 1e-12))
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)

    def pooled(self, texts: pa.Array, block: int = 1536) -> np.ndarray:
        """Mean probabilities (rows, K) over all bytes of each text."""
        w, k = self.how.window, len(self.langs)
        total = np.zeros((len(texts), k))
        for s in slices(texts):
            size = np.diff(s.off) - 1
            n = -(-size // w)
            text = np.repeat(np.arange(len(n)), n)
            first = np.repeat(s.off[:-1] - (np.cumsum(n) - n) * w, n) + np.arange(int(n.sum())) * w
            length = np.minimum(w, np.repeat(s.off[1:] - 1, n) - first)
            for i in range(0, len(first), block):
                a, m = first[i:i + block], length[i:i + block]
                at = a[None, :] + np.arange(w)[:, None]
                inside = np.arange(w)[:, None] < m
                x = np.where(inside, s.data[np.minimum(at, len(s.data) - 1)], 10)
                f, b = self.ahead.run(x), self.back.run(x[::-1])[::-1]
                p = self._probabilities(f, b)
                if not inside.all():
                    p *= inside[:, None, :]
                p = p.sum(axis=0)
                for j in range(k):
                    total[s.first:s.last, j] += np.bincount(text[i:i + block], weights=p[j], minlength=len(n))
            total[s.first:s.last] /= np.maximum(size, 1)[:, None]
        return total


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", how: Setup = Setup()) -> Network | None:
    """Trained on windows from a bounded number of labelled texts; None if there is none. Which texts, and where
    in them, follows from hashes of the text alone."""
    w, text = how.train_window, F.col(text_col)
    place = lambda i: F.pmod(F.xxhash64(text, F.lit(i)), F.greatest(F.length(text) - w, F.lit(0)) + 1).cast("int") + 1
    known = docs.where(F.col(lang_col).isNotNull())
    each = (known.where(text.rlike(r"\p{L}"))
            .select(F.col(lang_col).alias("lang"), F.xxhash64(text).alias("at"), F.array(*[F.substr(text, place(i), F.lit(w)) for i in range(how.stretches)]).alias("w")))
    sample = lowest(each, "at", how.rows, known.count(), "lang").collect()
    rows = [(r["lang"], s.encode()[:w]) for r in sample for s in r["w"]]
    if not rows:
        return None
    langs = sorted({r[0] for r in rows})
    x = np.frombuffer(b"".join(s.ljust(w, b"\n") for _, s in rows), dtype=np.uint8).reshape(len(rows), w).T
    net = Network(langs, how)
    net.train(np.ascontiguousarray(x), np.array([langs.index(r[0]) for r in rows]))
    return net


def predictor(net: Network):
    @F.arrow_udf("lang string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        p = net.pooled(texts)
        best = p.argmax(axis=1) if len(p) else np.zeros(0, int)
        return pa.StructArray.from_arrays([pa.array([net.langs[i] for i in best], pa.string()), pa.array(np.clip(p[np.arange(len(p)), best], 0, 1))], ["lang", "score"])
    return predict


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", how: Setup = Setup()) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score.

    Documents whose crc32 of the id as text is a multiple of five are held out; those with a null id are neither held
    out nor learnt from. Null texts and texts without a letter are 'und' with score 0, as are all if there is nothing
    to learn from. Repeated rows stay; columns other than id, text and language are not read. No shuffle.
    """
    fold = F.crc32(F.col(id_col).cast("string")) % 5
    net = learn(docs.where(fold != 0), text_col, lang_col, how)
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    d = docs.select(F.col(id_col), F.coalesce(fold == 0, F.lit(False)).alias("held_out"), F.col(text_col).alias("body"), letters.alias("letters"))
    if net is None:
        return d.select(id_col, "held_out", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    d = d.select(id_col, "held_out", "letters", predictor(net)(F.when(F.col("letters"), F.col("body"))).alias("p"))
    return d.select(id_col, "held_out", F.when(F.col("letters"), F.col("p.lang")).otherwise(UNDETERMINED).alias("lang_pred"),
                    F.when(F.col("letters"), F.col("p.score")).otherwise(0.0).alias("score"))
