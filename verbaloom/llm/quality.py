"""Document quality by Bradley-Terry ranking on preference pairs.

A document's strength is linear in its features. For a pair (better, worse) the probability that the better wins is
the logistic function of the difference of strengths, so the weights come from logistic loss on feature differences:
of all pairs of a label 1 and a label 0. No labelled document is left out. Features stay where they are; each pass over
them gives sums of a fixed size. The decision is the strength that divides the labelled documents best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, fold, ship, small_batches, stored, text_groups

#: Gaps between knots; bins of strengths in a pass of the loss, and of a pass that looks for a quantile or a cut.
GAPS, BINS, FINE = 5, 256, 256
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_SYMBOL = b"#$%&*+<=>@\\^_`{|}~"
_STRONG = b"!?"
_ENDS = (b"# ", b"$ ", b"% ", b"& ", b"* ", b"| ", b"! ")
_PLAIN = b".,;:'\"()-"
NAMES = ["words", "word_length", "distinct", "repeats", "upper", "digit", "symbol", "strong", "plain", "lines", "same_lines", "longest_word", "top_word", "symbol_words", "letters"]


def features(text: str | None) -> list[float]:
    """Numbers about a whole text; a null text is an empty one."""
    b = text.encode("utf-8", "surrogatepass") if text else b""
    words = b.split()
    n, size = max(1, len(words)), max(1, len(b))
    without = lambda chars: len(b) - len(b.translate(None, chars))
    distinct = len(set(words))
    repeats = sum(map(eq, words, words[1:]))
    lines = [x for x in b.split(b"\n") if x.strip()]
    upper, lower, symbol = without(_UPPER), without(_LOWER), without(_SYMBOL)
    letters = upper + lower + without(bytes(range(128, 256)))
    ends = sum(map(b.count, _ENDS))
    return [
        np.log1p(len(words)), len(b) / n, distinct / n**0.8, repeats / n, upper / max(1, upper + lower), without(_DIGIT) / size, symbol / size, without(_STRONG) / size,
        without(_PLAIN) / size, len(lines) / n, (len(lines) - len(set(lines))) / max(1, len(lines)), np.log1p(max(map(len, words), default=0)), words.count(words[len(words) // 2]) / n if words else 0.0, ends / n, letters / size,
    ]


def measured(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, f (features) and the columns ``more`` (long)."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_groups(batches):
            f = pa.array([features(t) for t in texts], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), f, *(batch.column(2 + k) for k in range(len(more)))], names=["doc_id", "f", *more])

    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).cast("long").alias(c) for c in more)]
    return docs.select(*cols).mapInArrow(run, "doc_id long, f array<double>" + "".join(f", {c} long" for c in more))


@dataclass
class Ranking:
    knots: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float
    at: float = 0.3

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Each feature as its share of the way through every gap between knots, so that strengths may bend."""
        parts = []
        for k in range(x.shape[1]):
            low, high = self.knots[k, :-1], self.knots[k, 1:]
            parts.append(np.clip((x[:, k : k + 1] - low) / np.maximum(high - low, 1e-9), 0, 1))
        return np.concatenate(parts, axis=1)

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Strengths in 0 to 1, the threshold being at ``at``."""
        z = self.scale * (self.strengths(x) - self.threshold) + np.log(self.at / (1 - self.at))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def pair_loss(w: np.ndarray, d: np.ndarray, ridge: float = 1e-4) -> tuple[float, np.ndarray]:
    """Mean logistic loss of feature differences d (better less worse), with a small ridge, and its gradient."""
    z = d @ w
    return float(np.logaddexp(0, -z).mean() + ridge / 2 * w @ w), -(d / (1 + np.exp(np.minimum(z, 500)))[:, None]).mean(axis=0) + ridge * w


#: Runs a function of (features, labels) on every block of the labelled documents, and gives what it returns for each.
Passes = Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray]], list[np.ndarray]]


def order_statistics(each: Passes, low: np.ndarray, high: np.ndarray, ranks: np.ndarray, passes: int = 4) -> np.ndarray:
    """For each feature the values of the given ranks (from 0) among all rows, to FINE ** -passes of the feature's range."""
    lo = np.repeat(low[:, None], len(ranks), axis=1)
    hi = np.repeat(np.nextafter(high, np.inf)[:, None], len(ranks), axis=1)
    for _ in range(passes):
        edges = np.linspace(lo, hi, FINE + 1, axis=-1)

        def counts(x: np.ndarray, y: np.ndarray, edges: np.ndarray = edges) -> np.ndarray:
            at = [[np.bincount(np.searchsorted(e, x[:, k], side="right"), minlength=FINE + 2) for e in edges[k]] for k in range(x.shape[1])]
            return np.array(at, dtype=np.float64)

        below = np.cumsum(sum(each(counts)), axis=-1)
        place = np.clip((below <= ranks[None, :, None]).sum(axis=-1) - 1, 0, FINE - 1)[..., None]
        lo, hi = np.take_along_axis(edges, place, -1)[..., 0], np.take_along_axis(edges, place + 1, -1)[..., 0]
    return lo


def reach(w: np.ndarray) -> tuple[float, float]:
    """Bounds of all strengths, as expanded features lie in 0 to 1."""
    return float(np.minimum(w, 0).sum()) - 1e-6, float(np.maximum(w, 0).sum()) + 1e-6


def all_pairs_loss(each: Passes, model: Ranking, w: np.ndarray, ridge: float = 1e-4) -> tuple[float, np.ndarray]:
    """``pair_loss`` of all (label 1, label 0) pairs, and its gradient.

    A document's strength counts as the mean of its label in one of BINS bins, which is wrong by the square of a bin's width.
    """
    low, high = reach(w)

    def sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros((2 * BINS, len(w) + 1))
        for a in range(0, len(x), 8192):
            e = model.expand(x[a : a + 8192])
            place = np.clip(((e @ w - low) / (high - low) * BINS).astype(np.int64), 0, BINS - 1) + BINS * y[a : a + 8192]
            order = np.argsort(place, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(place[order]) != 0])
            out[place[order][first]] += np.add.reduceat(np.c_[e, np.ones(len(e))][order], first, axis=0)
        return out

    bad, good = np.split(sum(each(sums)), 2)
    bad, good = bad[bad[:, -1] > 0], good[good[:, -1] > 0]
    pairs = good[:, -1].sum() * bad[:, -1].sum()
    z = (good[:, :-1] @ w / good[:, -1])[:, None] - (bad[:, :-1] @ w / bad[:, -1])[None, :]
    wrong = 1 / (1 + np.exp(np.minimum(z, 500)))
    loss = good[:, -1] @ np.logaddexp(0, -z) @ bad[:, -1] / pairs + ridge / 2 * w @ w
    return float(loss), -((wrong @ bad[:, -1]) @ good[:, :-1] - (good[:, -1] @ wrong) @ bad[:, :-1]) / pairs + ridge * w


def learn(each: Passes, columns: int, at: float = 0.3, rounds: int = 30, ridge: float = 1e-4) -> Ranking:
    """Knots at the quantiles, weights by L-BFGS from all pairs, and the cut that divides best, of all labelled rows."""
    ends = [r for r in each(lambda x, y: np.array([x.min(axis=0), x.max(axis=0), np.full(x.shape[1], len(y)), np.full(x.shape[1], y.sum())], dtype=np.float64) if len(y) else np.zeros((4, 0))) if r.size]
    width = columns * GAPS
    if not ends:
        return Ranking(np.tile(np.arange(GAPS + 1.0), (columns, 1)), np.zeros(width), 0.0, 1.0, at)
    low, high = np.min([r[0] for r in ends], axis=0), np.max([r[1] for r in ends], axis=0)
    n, good = (int(sum(r[k, 0] for r in ends)) for k in (2, 3))
    inner = order_statistics(each, low, high, np.floor(np.linspace(0, 1, GAPS + 1)[1:-1] * (n - 1)))
    knots = np.c_[low, inner, high]
    # equal quantiles would make a gap of no width
    knots = np.maximum.accumulate(knots + 1e-6 * np.maximum(high - low, 1e-6)[:, None] * np.arange(GAPS + 1), axis=1)
    model = Ranking(knots, np.zeros(width), 0.0, 1.0, at)
    if not 0 < good < n:
        return model

    def moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros((2, width + 1, width))
        for a in range(0, len(x), 8192):
            e, mine = model.expand(x[a : a + 8192]), y[a : a + 8192]
            for k in (0, 1):
                out[k] += np.r_[e[mine == k].T @ e[mine == k], e[mine == k].sum(axis=0, keepdims=True)]
        return out

    both = sum(each(moments)) / np.array([n - good, good])[:, None, None]
    cross = np.outer(both[0, -1], both[1, -1])
    # the second derivative of the loss is nowhere more than this, so a step by its inverse goes down
    bound = np.linalg.inv((both[0, :-1] + both[1, :-1] - cross - cross.T) / 4 + ridge * np.eye(width))
    w = np.zeros(width)
    loss, g = all_pairs_loss(each, model, w, ridge)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, held = g.copy(), []
        for d, c in reversed(steps):
            held.append(d @ q / (d @ c))
            q -= held[-1] * c
        q = bound @ q
        for (d, c), h in zip(steps, reversed(held)):
            q += (h - c @ q / (d @ c)) * d
        if g @ q < 1e-8:
            break
        new, slope = all_pairs_loss(each, model, w - q, ridge)
        if new > loss:
            if not steps:
                break
            steps = []
            continue
        if -q @ (slope - g) > 1e-12:
            steps = [*steps[-9:], (-q, slope - g)]
        w, loss, g = w - q, new, slope
    model.weights = w

    def spread(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        s = model.strengths(x)
        return np.array([s.sum(), s @ s])

    total, square = sum(each(spread)) / n
    lo, hi = reach(w)
    for _ in range(3):
        edges = np.linspace(lo, hi, 16 * FINE + 1)

        def counts(x: np.ndarray, y: np.ndarray, edges: np.ndarray = edges) -> np.ndarray:
            place = np.searchsorted(edges, model.strengths(x), side="right")
            return np.array([np.bincount(place[y == k], minlength=len(edges) + 1) for k in (0, 1)], dtype=np.float64)

        below = np.cumsum(sum(each(counts)), axis=1)[:, :-1]
        balance = 1 - below[1] / good + below[0] / (n - good)
        # the middle of the first run of best cuts
        best = int(np.argmax(balance))
        run = best + int(np.argmax(np.r_[balance[best:] != balance[best], True])) - 1
        model.threshold = float((edges[best] + edges[run]) / 2)
        if run > best:
            break
        lo, hi = edges[max(0, best - 1)], edges[min(len(edges) - 1, best + 1)]
    model.scale = float(2 / max(1e-9, max(0.0, square - total * total) ** 0.5))
    return model


def fit(x: np.ndarray, y: np.ndarray, at: float = 0.3) -> Ranking:
    """A ranking from rows in memory."""
    return learn(lambda f: [f(x, np.asarray(y, dtype=np.int64))], x.shape[1], at)


def train_measured(found: DataFrame, labels: DataFrame, column: str) -> Ranking:
    """A ranking from all labelled rows of (doc_id, f); null labels are left out."""
    usable = labels.where(F.col(column).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("long").alias("label"))
    rows = stored(found.select("doc_id", "f").join(usable, "doc_id").select("f", "label"), "labelled")
    small_batches(found.sparkSession, 8192)
    size = len(NAMES)

    def each(f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = [(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size), b.column(1).to_numpy()) for b in batches if b.num_rows]
            if blocks:
                out = f(np.concatenate([x for x, _ in blocks]), np.concatenate([y for _, y in blocks])).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()]), pa.array([list(out.shape)], pa.list_(pa.int64()))], names=["sums", "shape"])

        return [np.frombuffer(r.sums).reshape(r["shape"]) for r in rows.mapInArrow(run, "sums binary, shape array<long>").collect()]

    return learn(each, size)


def train(docs: DataFrame, labels: DataFrame, column: str) -> Ranking:
    """A ranking from all labelled documents; null labels are left out."""
    return train_measured(measured(docs.select("doc_id", "text")), labels, column)


def rate_measured(found: DataFrame, model: Ranking) -> DataFrame:
    """doc_id, score and predicted of rows (doc_id, f)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = model.scores(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= model.at).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return found.select("doc_id", "f").mapInArrow(run, "doc_id long, score double, predicted int")


def rate(docs: DataFrame, model: Ranking) -> DataFrame:
    """Per document (doc_id, text): score in 0 to 1 and predicted (1 if score >= model.at; a score equal to it is 1).

    Null texts are empty ones. Null and repeated doc_ids are rows like any other; other columns are ignored; an empty table
    gives no rows.
    """
    return rate_measured(measured(docs), model)


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels of held-out documents are not read."""
    found = stored(measured(documents(spark, sf_dir, "doc_id", "text")), "features")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 5) != 0)
    return rate_measured(found, train_measured(found, labels, "quality")).withColumn("held_out", fold("doc_id", 5) == 0).select("doc_id", "held_out", "score", "predicted")
