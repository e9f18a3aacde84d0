"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as two vectors: one of its own (hashed), and the mean of its character 3- and 4-grams' vectors (hashed,
with marks for the word's ends), so unseen forms of a known stem are read by their characters.  A text is cut into overlapping
windows of ``WINDOW`` words; the network reads each window in both directions, attention pools the states, and the
window gets a probability.  Windows start every ``STRIDE`` words, half a window: any run of up to that many words lies whole in some window.
A document's score is that of its worst window: all windows of whole texts are scored.

Labels belong to documents, so training looks for the window that carries the label: each round, the current
network picks the highest window of each document, and gradients go through it (plus a random one of clean documents).

The network is fitted on the driver to at most ``SAMPLE`` labelled documents of each class, chosen by a hash of the id among the labels whose document has a text of at most ``SAMPLE_CHARS`` code
points (longer ones are scored, but not learned from), and to those of a class together only up to ``SAMPLE_TEXT`` code points, so what the driver gets is bounded; its size is fixed.  Labels without such a document are not
counted.  Scoring is one pass over the documents, without a shuffle.

Defined results for odd input: null or wordless texts score 0; without labels of both classes every text scores the
share of toxic labels (0 if there are none); equal texts get equal scores, each row its own; an id with several labels is toxic if one of
them says so; of several rows with a labelled id the one with the least hash of its text is learned from; rows with a null doc_id are
never held out or learned from; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, utf8_values
from .decontam import fold_words

WINDOW, STRIDE = 32, 16
#: Labelled documents of each class that are learned from, at most, and code points that one of them, and all of a class, may have.
SAMPLE, SAMPLE_CHARS, SAMPLE_TEXT = 1500, 65_536, 16 << 20
BUCKETS, WIDTH, HIDDEN, ATTENTION = 1 << 14, 8, 12, 8
ROUNDS, BATCH, RATE = 8, 64, 0.01
CUT = 0.3
#: Windows that go through the network together when texts are scored.
CHUNK = 2048

_HASH = np.uint64(0x9E3779B97F4A7C15)


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Features:
    """Bucket numbers of words and of their character grams."""

    def __init__(self, words: list[bytes]) -> None:
        self.n = len(words)
        sizes = np.array([len(w) for w in words], np.int64) + 2
        raw = np.frombuffer(b"".join(b"\x02%b\x03" % w for w in words), np.uint8).astype(np.uint64)
        self.owner = np.repeat(np.arange(self.n), sizes)
        last = np.cumsum(sizes)
        room = last[self.owner] - np.arange(len(raw))
        grams, owners = [], []
        code = np.zeros(len(raw), np.uint64)
        whole = np.zeros(self.n, np.uint64)
        weight = (np.cumprod(np.full(int(sizes.max(initial=1)), _HASH, dtype=np.uint64)))[np.arange(len(raw)) - (last - sizes)[self.owner]] if self.n else raw
        if self.n:
            whole = np.add.reduceat(raw * weight, last - sizes)
        self.word = (((whole ^ (whole >> np.uint64(29))) * _HASH) >> np.uint64(40)) % np.uint64(BUCKETS)
        for k in range(4):
            shifted = np.concatenate([raw[k:], np.zeros(k, np.uint64)])
            code = code * np.uint64(257) + shifted + np.uint64(1)
            if k >= 2:
                fits = room > k
                grams.append((((code[fits] * _HASH) >> np.uint64(36)) + np.uint64(k)) % np.uint64(BUCKETS))
                owners.append(self.owner[fits])
        gram, owner = np.concatenate(grams), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        self.gram, self.owner = gram[order].astype(np.int64), owner[order]
        self.word = self.word.astype(np.int64)
        self.counts = np.bincount(self.owner, minlength=self.n).astype(np.float32)
        self.first = np.concatenate([[0], np.cumsum(self.counts[:-1])]).astype(np.int64) if self.n else np.zeros(0, np.int64)

    def take(self, which: np.ndarray) -> Features:
        """The features of some of the words, in this order."""
        out = object.__new__(Features)
        out.n, out.word, out.counts = len(which), self.word[which], self.counts[which]
        n = out.counts.astype(np.int64)
        out.first = np.concatenate([[0], np.cumsum(n[:-1])]) if len(n) else n
        at = np.repeat(self.first[which] - out.first, n) + np.arange(n.sum())
        out.gram, out.owner = self.gram[at], np.repeat(np.arange(out.n), n)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """Parameters by name, and the forward and backward passes."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        norm = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        p = {"words": rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32), "grams": rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)}
        for d in "fb":
            p |= {f"W{d}": norm(2 * WIDTH, 3 * HIDDEN), f"U{d}": norm(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        p |= {"A": norm(2 * HIDDEN, ATTENTION), "a": np.zeros(ATTENTION, np.float32), "v": norm(ATTENTION, 1)[:, 0], "u": norm(2 * HIDDEN, 1)[:, 0], "bias": np.zeros(1, np.float32)}
        return cls(p)

    def inputs(self, f: Features) -> np.ndarray:
        """(words, 2 * WIDTH) input vectors; one more row of zeros stands for padding."""
        out = np.zeros((f.n + 1, 2 * WIDTH), np.float32)
        if f.n:
            out[:-1, :WIDTH] = self.p["words"][f.word]
            out[:-1, WIDTH:] = np.add.reduceat(self.p["grams"][f.gram], f.first) / f.counts[:, None]
        return out

    def _read(self, gates: np.ndarray, index: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """States (T, B, HIDDEN) of one direction; with ``keep`` also what the backward pass needs."""
        batch, steps = index.shape
        u, h = self.p[f"U{d}"], np.zeros((batch, HIDDEN), np.float32)
        states, saved = np.empty((steps, batch, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g, m = gates[index[:, t]], mask[:, t, None]
            hu = h @ u
            zr = _sigmoid(g[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(g[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            new = h + m * (new - h)
            if keep:
                saved.append((t, h, z, r, n, hu[:, 2 * HIDDEN :]))
            h = new
            states[t] = h
        return states, saved

    def forward(self, inputs: np.ndarray, index: np.ndarray, keep: bool = False):
        """Logits of windows given as rows of word numbers (the last row of ``inputs`` is padding)."""
        mask = (index < len(inputs) - 1).astype(np.float32)
        parts = [self._read(inputs @ self.p[f"W{d}"] + self.p[f"c{d}"], index, mask, d, keep) for d in "fb"]
        h = np.concatenate([parts[0][0], parts[1][0]], axis=2)
        q = np.tanh(h @ self.p["A"] + self.p["a"])
        e = np.where(mask.T > 0, q @ self.p["v"], -1e9)
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = np.einsum("tb,tbh->bh", w, h)
        logit = pooled @ self.p["u"] + self.p["bias"][0]
        return (logit, (mask, parts, h, q, w, pooled)) if keep else logit

    def gradients(self, f: Features, inputs: np.ndarray, index: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy."""
        p = self.p
        logit, (mask, parts, h, q, w, pooled) = self.forward(inputs, index, True)
        d_logit = ((_sigmoid(logit) - label) / len(label)).astype(np.float32)
        g = {"u": pooled.T @ d_logit, "bias": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["u"]
        d_w = np.einsum("bh,tbh->tb", d_pooled, h)
        d_h = w[:, :, None] * d_pooled[None]
        d_e = w * (d_w - (w * d_w).sum(0))
        d_q = d_e[:, :, None] * p["v"]
        g["v"] = np.einsum("tb,tba->a", d_e, q)
        d_pre = d_q * (1 - q * q)
        g["A"] = np.einsum("tbh,tba->ha", h, d_pre)
        g["a"] = d_pre.sum((0, 1))
        d_h += d_pre @ p["A"].T
        d_inputs = np.zeros_like(inputs)
        for k, d in enumerate("fb"):
            u, carry = p[f"U{d}"], np.zeros((len(index), HIDDEN), np.float32)
            g[f"U{d}"], d_gates = np.zeros_like(u), np.zeros((len(inputs), 3 * HIDDEN), np.float32)
            for t, before, z, r, n, hun in reversed(parts[k][1]):
                total = d_h[t, :, k * HIDDEN : (k + 1) * HIDDEN] + carry
                m = mask[:, t, None]
                new = m * total
                d_n = new * (1 - z) * (1 - n * n)
                d_z = new * (before - n) * z * (1 - z)
                d_r = d_n * hun * r * (1 - r)
                back = np.concatenate([d_z, d_r, d_n * r], axis=1)
                g[f"U{d}"] += before.T @ back
                carry = (1 - m) * total + new * z + back @ u.T
                np.add.at(d_gates, index[:, t], np.concatenate([d_z, d_r, d_n], axis=1))
            g[f"W{d}"], g[f"c{d}"] = inputs.T @ d_gates, d_gates.sum(0)
            d_inputs += d_gates @ p[f"W{d}"].T
        g["words"], g["grams"] = np.zeros_like(p["words"]), np.zeros_like(p["grams"])
        np.add.at(g["words"], f.word, d_inputs[:-1, :WIDTH])
        np.add.at(g["grams"], f.gram, (d_inputs[:-1, WIDTH:] / f.counts[:, None])[f.owner])
        return g


def windows_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and first word (inside the document) of every window; the last one ends at or after the last word."""
    count = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(sizes)), count)
    return doc, (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE


class Texts:
    """Texts as windows over the distinct words of all of them."""

    def __init__(self, texts: list[bytes | None]) -> None:
        number: dict[bytes, int] = {}
        words = [[number.setdefault(w, len(number)) for w in fold_words(t)] for t in texts]
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.flat = np.fromiter((i for w in words for i in w), np.int64, int(self.sizes.sum()))
        self.features = Features(list(number))
        self.doc, first = windows_of(self.sizes)
        self.first, self.stop = first + (np.cumsum(self.sizes) - self.sizes)[self.doc], np.cumsum(self.sizes)[self.doc]

    def index(self, which: np.ndarray) -> np.ndarray:
        """Word numbers of these windows, padded with the number of words."""
        at = self.first[which, None] + np.arange(WINDOW)
        inside = at < self.stop[which, None]
        return np.where(inside, self.flat[np.minimum(at, max(len(self.flat) - 1, 0))], self.features.n) if len(self.flat) else np.full(at.shape, self.features.n)

    def logits(self, net: Network) -> np.ndarray:
        """Of all windows."""
        inputs = net.inputs(self.features)
        parts = [net.forward(inputs, self.index(np.arange(i, min(i + CHUNK, len(self.doc))))) for i in range(0, len(self.doc), CHUNK)]
        return np.concatenate([np.zeros(0, np.float32), *parts])


def train(texts: list[bytes], labels: list[int], seed: int = 7) -> Network:
    """Fit a network to labelled texts, Adam over the windows that carry the labels."""
    rng, net, data = np.random.default_rng(seed), Network.fresh(seed), Texts(texts)
    y = np.array(labels, np.float32)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step, count = 0, np.bincount(data.doc, minlength=len(y))
    begin, have = np.cumsum(count) - count, np.flatnonzero(count > 0)
    for rnd in range(ROUNDS):
        spare = begin[have] + (rng.random(len(have)) * count[have]).astype(np.int64)
        if rnd == 0:
            chosen = np.concatenate([spare, begin[have] + (rng.random(len(have)) * count[have]).astype(np.int64)])
        else:
            score = data.logits(net)
            order = np.lexsort((score, data.doc))
            top = order[(np.cumsum(count) - 1)[have]]
            chosen = np.concatenate([top, spare[y[have] == 0]])
        rng.shuffle(chosen)
        rate = RATE * (1 - 0.8 * rnd / ROUNDS)
        for i in range(0, len(chosen), BATCH):
            index = data.index(chosen[i : i + BATCH])
            used, local = np.unique(index, return_inverse=True)
            local = local.reshape(index.shape)
            words = used[used < data.features.n]
            f = data.features.take(words)
            g = net.gradients(f, net.inputs(f), local, y[data.doc[chosen[i : i + BATCH]]])
            step += 1
            for k, v in g.items():
                m, s = moments[k]
                m += 0.1 * (v - m)
                s += 0.001 * (v * v - s)
                net.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Network | None, float]:
    """A network from the labelled documents that are not held out, and the share of toxic ones among them."""
    usable = labels.where(~is_held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    fits = docs.where(~is_held_out(F.col("doc_id")) & (F.length("text") <= SAMPLE_CHARS)).select("doc_id", "text")
    # The sample is taken from labels that have a text to learn from, so that others do not use it up.
    known = usable.join(fits.groupBy("doc_id").agg(F.max(F.length("text")).alias("chars")), "doc_id")
    by_class = [known.where((F.col("toxic") > 0) == bool(c)).withColumn("class", F.lit(c)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    so_far = F.sum("chars").over(Window.partitionBy("class").orderBy(F.xxhash64("doc_id"), "doc_id"))  # over at most `sample` rows
    within = by_class[0].unionByName(by_class[1]).withColumn("total", so_far).where(F.col("total") <= SAMPLE_TEXT)
    chosen = F.broadcast(within.select("doc_id", "toxic"))  # at most twice `sample` rows
    short = fits.join(chosen, "doc_id")
    rows = short.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t")).select("doc_id", "t.text", "toxic").collect()
    rows = sorted((r["doc_id"], r["text"], int(r["toxic"] > 0)) for r in rows)
    y = [r[2] for r in rows]
    share = sum(y) / len(y) if y else 0.0
    if len(set(y)) < 2:
        return None, share
    return train([r[1].encode() for r in rows], y), share


def score_documents(docs: DataFrame, net: Network | None, share: float = 0.0) -> DataFrame:
    """doc_id, score (of the highest window) and n_windows of every row of ``docs``."""

    def run(batches):
        for b in batches:
            values = utf8_values(b.column(1))
            data = Texts(values)
            score = np.zeros(len(values))
            if net is None:
                score[:] = share
            elif len(data.doc):
                np.maximum.at(score, data.doc, _sigmoid(data.logits(net).astype(np.float64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array(np.bincount(data.doc, minlength=len(values)))], names=["doc_id", "score", "n_windows"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double, n_windows long")
