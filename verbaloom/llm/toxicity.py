"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its hashed word vector plus the mean of its hashed character n-gram vectors. A window's states, from
both directions, are pooled with attention and give one probability. A document is toxic if any of its overlapping
windows is, so training takes the noisy-or of a document's windows, and scoring takes their maximum.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, fold, ship, small_batches, text_groups
from .langid import ngram_hash, word_codes
from .sample import draw

_WORD = re.compile(r"[^\W\d_]+")
WINDOW, STEP = 64, 32
WORDS, GRAMS, DIM, HIDDEN = 1 << 14, 1 << 14, 12, 8
#: Bounds of the training sample: documents of each label, and characters in one of them.
TRAIN_DOCS, TRAIN_CHARS = 2500, 10_000
CACHE_WORDS = 150_000
#: Training goes on for so many steps at least, however few the texts.
LEAST_STEPS = 200


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def word_inputs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word; buckets of all their character n-grams (3 to 5, with marks), and the word of each."""
    buckets = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORDS for w in words), dtype=np.int64, count=len(words))
    if not words:
        return buckets, np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes, place, first = word_codes(words)
    owner = np.repeat(np.arange(len(words)), np.diff(np.r_[first, len(codes)]))
    grams, of = [], []
    for n in (3, 4, 5):
        at = np.flatnonzero(place >= n - 1)
        grams.append((ngram_hash(codes, n)[at] % np.uint64(GRAMS)).astype(np.int64))
        of.append(owner[at])
    grams, of = np.concatenate(grams), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return buckets, grams[order], of[order]


def windows_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts with these numbers of words, the windows: text, first word (in all texts' words), number of words.

    Windows start every STEP words; the last one ends with the text. A text without words has one empty window.
    """
    n = np.maximum(1, -(-(sizes - WINDOW) // STEP) + 1)
    text = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    start = np.minimum(k * STEP, np.maximum(0, sizes - WINDOW)[text])
    return text, start + (np.cumsum(sizes) - sizes)[text], np.minimum(sizes, WINDOW)[text]


def summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, and the sums of their values."""
    order = np.argsort(rows, kind="stable")
    r = rows[order]
    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]][: len(r)])
    return r[first], np.add.reduceat(values[order], first, axis=0) if len(first) else values[:0]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Net:
    p: dict[str, np.ndarray]
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    @classmethod
    def new(cls, seed: int = 11) -> Net:
        r = np.random.default_rng(seed)
        p = {"ew": r.normal(0, 0.1, (WORDS, DIM)), "eg": r.normal(0, 0.1, (GRAMS, DIM)), "a": r.normal(0, 0.1, 2 * HIDDEN), "o": r.normal(0, 0.5, 2 * HIDDEN), "c": np.array([-3.0])}
        for d in "fb":
            p |= {"w" + d: r.normal(0, DIM**-0.5, (DIM, 3 * HIDDEN)), "u" + d: r.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)), "v" + d: np.zeros(3 * HIDDEN)}
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def vectors(self, buckets: np.ndarray, grams: np.ndarray, of: np.ndarray) -> np.ndarray:
        x = self.p["ew"][buckets].copy()
        if len(of):
            n = np.bincount(of, minlength=len(buckets))
            some = np.flatnonzero(n)
            sums = np.add.reduceat(self.p["eg"][grams], np.cumsum(n)[some] - n[some], axis=0)
            x[some] += sums / n[some][:, None]
        return x

    def gates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the words' vectors bring to the gates, for each direction."""
        return x @ self.p["wf"] + self.p["vf"], x @ self.p["wb"] + self.p["vb"]

    def run(self, g: tuple[np.ndarray, np.ndarray], rows: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logit of each window; rows: its words' rows of g (windows, steps); mask: which are words. keep: gets what the way back needs."""
        hd = HIDDEN
        n, steps = rows.shape
        states = np.zeros((steps, n, 2 * hd), dtype=np.float32)
        full = mask.all()
        for d, name in enumerate("fb"):
            u = self.p["u" + name]
            h = np.zeros((n, hd), dtype=np.float32)
            mine = g[d]
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                x = mine[rows[:, t]]
                y = h @ u
                zr = sigmoid(x[:, : 2 * hd] + y[:, : 2 * hd])
                z, r = zr[:, :hd], zr[:, hd:]
                c = np.tanh(x[:, 2 * hd :] + r * y[:, 2 * hd :])
                new = c + z * (h - c)
                if not full:
                    new = np.where(mask[:, t : t + 1], new, h)
                if keep is not None:
                    keep.append((d, t, h, z, r, c, y[:, 2 * hd :]))
                h = new
                states[t, :, d * hd : (d + 1) * hd] = h
        e = states @ self.p["a"]
        e = np.where(mask.T, e, -1e9)
        w = np.exp(e - e.max(axis=0))
        w = np.where(mask.T, w, 0)
        w /= np.maximum(w.sum(axis=0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", w, states)
        if keep is not None:
            keep.append((states, w, pooled))
        return pooled @ self.p["o"] + self.p["c"][0]

    def back(self, rows: np.ndarray, mask: np.ndarray, keep: list, dlogit: np.ndarray, n_rows: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters behind the gates, and of the gates (as g)."""
        h3, hd = 3 * HIDDEN, HIDDEN
        states, w, pooled = keep.pop()
        out = {"o": pooled.T @ dlogit, "c": np.array([dlogit.sum()], dtype=np.float32)}
        dpool = dlogit[:, None] * self.p["o"]
        dw = np.einsum("tnh,nh->tn", states, dpool)
        de = w * (dw - (w * dw).sum(axis=0))
        out["a"] = np.einsum("tn,tnh->h", de, states)
        dstates = w[:, :, None] * dpool + de[:, :, None] * self.p["a"]
        dg = np.zeros((n_rows, 2 * h3), dtype=np.float32)
        for d, name in enumerate("fb"):
            u, du, dh = self.p["u" + name], np.zeros_like(self.p["u" + name]), np.zeros((rows.shape[0], hd), np.float32)
            brought = np.zeros((rows.shape[1], rows.shape[0], h3), dtype=np.float32)
            for k, t, h, z, r, c, yn in reversed(keep):
                if k != d:
                    continue
                dh = dh + dstates[t, :, d * hd : (d + 1) * hd]
                m = mask[:, t : t + 1]
                dnew = dh * m
                dc = dnew * (1 - z) * (1 - c * c)
                dz = dnew * (h - c) * z * (1 - z)
                dr = dc * yn * r * (1 - r)
                dx = np.concatenate([dz, dr, dc], axis=1)
                dy = np.concatenate([dz, dr, dc * r], axis=1)
                du += h.T @ dy
                brought[t] = dx
                dh = dy @ u.T + dnew * z + dh * ~m
            out["u" + name] = du
            at, total = summed(rows.T.ravel(), brought.reshape(-1, h3))
            dg[at, d * h3 : (d + 1) * h3] = total
        return out, dg


def batches_of(sizes: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Texts in groups of about ``most`` windows."""
    n = np.cumsum(np.maximum(1, -(-(sizes - WINDOW) // STEP) + 1))
    yield from np.split(np.arange(len(sizes)), np.searchsorted(n, np.arange(most, n[-1] if len(n) else 0, most)))


def padded(rows: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps = max(1, int(size.max(initial=0)))
    mask = np.arange(steps) < size[:, None]
    at = np.where(mask, start[:, None] + np.arange(steps), 0)
    return (rows[at] if len(rows) else np.zeros_like(at)), mask


def fit(texts: list[str | None], labels: np.ndarray, epochs: int = 4, seed: int = 11, rate: float = 0.01) -> Net:
    """A net from whole texts and 0/1 labels. Every fifth text only calibrates: logits are shifted so that 0.5 divides those best.

    The dividing line maximises true positives less five times false positives, as clean documents are many; among
    equal lines it is the middle one.
    """
    net, r = Net.new(seed), np.random.default_rng(seed)
    if len(texts) < 5:
        return net
    held = np.arange(len(texts)) % 5 == 4
    kept = texts
    texts, labels, later = [t for t, h in zip(texts, held) if not h], labels[~held], labels[held]
    lists = [words_of(t) for t in texts]
    names = sorted(set(chain.from_iterable(lists)))
    row = {w: i for i, w in enumerate(names)}
    coded = [np.array([row[w] for w in x], dtype=np.int64) for x in lists]
    buckets, grams, of = word_inputs(names)
    first = np.searchsorted(of, np.arange(len(names) + 1))
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    step = 0
    epoch = 0
    while epoch < epochs or step < LEAST_STEPS:
        epoch += 1
        order = r.permutation(len(texts))
        for group in batches_of(np.array([len(coded[i]) for i in order]), 192):
            docs = order[group]
            if not len(docs):
                continue
            sizes = np.array([len(coded[i]) for i in docs])
            used, rows = np.unique(np.concatenate([coded[i] for i in docs]), return_inverse=True)
            n = first[used + 1] - first[used]
            pick = np.repeat(first[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            g_of = np.repeat(np.arange(len(used)), n)
            x = net.vectors(buckets[used], grams[pick], g_of)
            if not len(used):
                x = np.zeros((1, DIM), np.float32)
            text, start, size = windows_of(sizes)
            idx, mask = padded(rows, start, size)
            keep: list = []
            logit = net.run(net.gates(x), idx, mask, keep)
            p = sigmoid(logit)
            none = np.exp(np.bincount(text, np.log(np.maximum(1 - p, 1e-7)), minlength=len(docs)))
            some = np.maximum(1 - none, 1e-7)
            y = labels[docs]
            d = np.where(y[text] == 1, -p * (none / some)[text], p).astype(np.float32) / len(docs)
            grad, dg = net.back(idx, mask, keep, d, len(x))
            h3 = 3 * HIDDEN
            grad |= {"wf": x.T @ dg[:, :h3], "wb": x.T @ dg[:, h3:], "vf": dg[:, :h3].sum(axis=0), "vb": dg[:, h3:].sum(axis=0)}
            dx = dg[:, :h3] @ net.p["wf"].T + dg[:, h3:] @ net.p["wb"].T
            step += 1
            scale = rate * min(1, step / 20) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, gk in grad.items():
                m[k] += 0.1 * (gk - m[k])
                v[k] += 0.001 * (gk * gk - v[k])
                net.p[k] -= scale * m[k] / (np.sqrt(v[k]) + 1e-8)
            if len(used):
                for k, at, change in (("ew", buckets[used], dx), ("eg", grams[pick], (dx / np.maximum(n, 1)[:, None])[g_of])):
                    # tables: only the rows in use move
                    cell, gk = summed(at, change)
                    m[k][cell] += 0.1 * (gk - m[k][cell])
                    v[k][cell] += 0.001 * (gk * gk - v[k][cell])
                    net.p[k][cell] -= scale * m[k][cell] / (np.sqrt(v[k][cell]) + 1e-8)
    if len({*later.tolist()}) == 2:
        texts, labels = [t for t, h in zip(kept, held) if h], later
    s = Scorer(net).logits(texts)
    cuts = np.unique(s)
    cuts = (cuts[1:] + cuts[:-1]) / 2
    if len(cuts) and (labels == 1).any() and (labels == 0).any():
        pos, neg = np.sort(s[labels == 1]), np.sort(s[labels == 0])
        gain = (1 - np.searchsorted(pos, cuts) / len(pos)) - 5 * (1 - np.searchsorted(neg, cuts) / len(neg))
        best = np.flatnonzero(gain >= gain.max() - 1e-12)
        net.p["c"] = net.p["c"] - np.float32(cuts[best[len(best) // 2]])
    net.name = uuid.uuid4().hex
    return net


class Scorer:
    """Gate inputs of distinct words, kept up to a bound."""

    def __init__(self, net: Net) -> None:
        self.net, self.place = net, {}
        self.table = (np.zeros((1, 3 * HIDDEN), np.float32),) * 2

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """The largest logit among all windows of each text."""
        lists = [words_of(t) for t in texts]
        new = set().union(*lists).difference(self.place)
        if len(self.place) + len(new) > CACHE_WORDS:
            self.place = {}
            new = set().union(*lists)
        words, at = list(new), len(self.place)
        if at + len(words) > len(self.table[0]):
            # room doubles, so that rows are seldom copied
            self.table = tuple(np.concatenate([t[:at], np.zeros((at + 2 * len(words), 3 * HIDDEN), np.float32)]) for t in self.table)
        self.place.update(zip(words, range(at, at + len(words))))
        for i in range(0, len(words), 8192):
            part = self.net.gates(self.net.vectors(*word_inputs(words[i : i + 8192])))
            for t, p in zip(self.table, part, strict=True):
                t[at + i : at + i + len(p)] = p
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        rows = np.fromiter(map(self.place.__getitem__, chain.from_iterable(lists)), dtype=np.int64, count=int(sizes.sum()))
        text, start, size = windows_of(sizes)
        out = np.empty(len(text), dtype=np.float64)
        full = size == WINDOW
        for kind in (np.flatnonzero(full), np.flatnonzero(~full)[np.argsort(size[~full], kind="stable")]):
            for at in range(0, len(kind), 2048):
                own = kind[at : at + 2048]
                out[own] = self.net.run(self.table, *padded(rows, start[own], size[own]))
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, text, out)
        return best


_SCORERS: dict[str, Scorer] = {}


def scorer_of(net: Net) -> Scorer:
    """The worker process keeps one scorer, that of the last net."""
    if net.name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[net.name] = Scorer(net)
    return _SCORERS[net.name]


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, most_chars: int = TRAIN_CHARS) -> Net:
    """A net from labelled documents, drawn by hash: about ``most`` of each label, of at most ``most_chars`` characters; null labels are left out."""
    usable = labels.where(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("label"))
    # 2 * most rows of two numbers
    sample = F.broadcast(draw(usable, "label", most))
    rows = docs.select("doc_id", "text").join(sample, "doc_id").where(F.length("text") <= most_chars).select("doc_id", "label", "text").collect()
    rows.sort(key=lambda r: (r.doc_id, r.label, r.text))
    return fit([r.text for r in rows], np.array([r.label for r in rows], dtype=np.int64))


def score(docs: DataFrame, net: Net) -> DataFrame:
    """Per document (doc_id, text): score in 0 to 1, the largest of all its windows, and predicted (score >= 0.5).

    Windows of WINDOW words start every STEP words, so any passage of WINDOW - STEP words or fewer lies whole in one. A
    null or empty text is one empty window. Null and repeated doc_ids are rows like any other; other columns are ignored;
    an empty table gives no rows. A score of exactly 0.5 is predicted 1.
    """
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    given = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(given.value)
        for batch, texts in text_groups(batches, limit=3_000_000):
            s = sigmoid(scorer.logits(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, net: Net) -> DataFrame:
    """The documents, with all their columns, that ``score`` does not predict to be toxic; nothing is shuffled.

    A null or empty text is scored as one empty window. Rows with null or repeated doc_ids are documents like any other;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    given = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(given.value)
        for batch, texts in text_groups(batches, limit=3_000_000):
            yield batch.filter(pa.array(sigmoid(scorer.logits(texts)) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels of held-out documents are not read."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 5) != 0)
    return score(docs, train(docs, labels)).withColumn("held_out", fold("doc_id", 5) == 0).select("doc_id", "held_out", "score", "predicted")
