"""Language identification with interpolated Kneser-Ney character models.

Words (runs of letters, lower-cased) are padded with a boundary mark, and a character is predicted from those before
it in its word; so a word's cross-entropy is its own, and each distinct word is scored once. The models of all
languages share sorted arrays of 64-bit n-gram hashes: a row for each n-gram has its interpolated log-probability in
every language, a row for each context its back-off weight.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, fold, ship, small_batches, text_groups
from .sample import draw

_WORD = re.compile(r"[^\W\d_]+")
ORDER = 5
MARK = "\x02"
#: Bounds of the training sample: documents a language, and characters in one of them.
TRAIN_DOCS, TRAIN_CHARS = 300, 20_000
CACHE_WORDS = 300_000
_BASE = 0x9E3779B97F4A7C15


def ngram_hash(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of codes[i - n + 1 : i + 1] at i (meaningless for i < n - 1)."""
    h = np.zeros(len(codes), dtype=np.uint64)
    for k in range(n):
        shifted = np.zeros_like(h)
        shifted[n - 1 - k :] = codes[: len(codes) - (n - 1 - k)] if n - 1 - k < len(codes) else 0
        h = (h ^ (shifted + np.uint64(1))) * np.uint64(_BASE)
        h ^= h >> np.uint64(29)
    return h


def word_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the padded words, the place of each in its word, and the words' first positions."""
    text = "".join([MARK + w + MARK for w in words])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    first = np.cumsum(size) - size
    return codes, np.arange(len(codes)) - np.repeat(first, size), first


def kneser_ney(words: Counter, alphabet: int) -> tuple[list[dict[str, float]], list[dict[str, float]]]:
    """By order (from 1): probability of each n-gram's last character, and the back-off weight of each context.

    An n-gram that starts a word keeps its count, as nothing comes before it; others count the distinct characters
    before them, but for the highest order. Absolute discounts are n1 / (n1 + 2 n2) for each order.
    """
    raw: list[Counter] = [Counter() for _ in range(ORDER + 1)]
    for w, c in words.items():
        s = MARK + w + MARK
        for i in range(1, len(s)):
            for n in range(1, min(ORDER, i + 1) + 1):
                raw[n][s[i - n + 1 : i + 1]] += c
    probs: list[dict[str, float]] = [{}]
    backs: list[dict[str, float]] = [{}]
    for n in range(1, ORDER + 1):
        if n == ORDER:
            counts = dict(raw[n])
        else:
            before = Counter(g[1:] for g in raw[n + 1])
            counts = {g: c if g[0] == MARK and n > 1 else before.get(g, 0) or c for g, c in raw[n].items()}
        once, twice = sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
        d = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.05
        total: dict[str, float] = defaultdict(float)
        kinds: dict[str, int] = defaultdict(int)
        for g, c in counts.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        back = {h: d * kinds[h] / total[h] for h in total}
        low = probs[n - 1] if n > 1 else None
        probs.append({g: (c - d) / total[g[:-1]] + back[g[:-1]] * (low[g[1:]] if low is not None else 1 / alphabet) for g, c in counts.items()})
        backs.append(back)
    return probs, backs


def log_prob(model: tuple[list[dict], list[dict]], s: str, i: int, alphabet: int) -> float:
    """Log-probability of s[i] after what comes before it, by plain recursion (for tests and for building arrays)."""
    probs, backs = model
    weight = 1.0
    for n in range(min(ORDER, i + 1), 0, -1):
        g = s[i - n + 1 : i + 1]
        if g in probs[n]:
            return float(np.log(weight * probs[n][g]))
        weight *= backs[n].get(g[:-1], 1.0)
    return float(np.log(weight / alphabet))


@dataclass
class Models:
    langs: list[str]
    alphabet: int
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    temperature: float = 1.0
    accept: float = 0.0
    most_bits: float = np.inf
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Natural log-probability of each word (with its end) in each language, and the number of characters."""
        codes, place, first = word_codes(words)
        out = np.zeros((len(codes), len(self.langs)))
        left = np.flatnonzero(place > 0)
        for n in range(ORDER, 0, -1):
            now = left[place[left] >= n - 1]
            if not len(now):
                continue
            keys, table = self.grams[n]
            h = ngram_hash(codes, n)[now]
            at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
            hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
            out[now[hit]] += table[at[hit]]
            miss = now[~hit]
            if n > 1:
                keys, table = self.contexts[n]
                h = ngram_hash(codes, n - 1)[miss - 1]
                at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                known = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                out[miss[known]] += table[at[known]]
            else:
                out[miss] += self.contexts[1][1][0] - np.log(self.alphabet)
            left = np.r_[left[place[left] < n - 1], miss]
        sums = np.add.reduceat(out, first, axis=0) if len(first) else np.zeros((0, len(self.langs)))
        size = np.diff(np.r_[first, len(codes)]) - 1
        return np.column_stack([sums, size]).astype(np.float32)


def build(words: dict[str, Counter]) -> Models:
    """Models of the word counts of each language."""
    langs = sorted(words)
    alphabet = len({c for w in words.values() for x in w for c in x}) + 2
    parts = {g: kneser_ney(words[g], alphabet) for g in langs}
    grams, contexts = [(np.zeros(0, np.uint64), np.zeros((0, len(langs))))], [(np.zeros(0, np.uint64), np.zeros((0, len(langs))))]
    for n in range(1, ORDER + 1):
        names = sorted(set().union(*(parts[g][0][n] for g in langs)))
        table = np.array([[log_prob(parts[g], x, n - 1, alphabet) for g in langs] for x in names]).reshape(-1, len(langs))
        grams.append(hashed(names, n, table))
        over = sorted(set().union(*(parts[g][1][n] for g in langs)))
        weight = np.array([[np.log(parts[g][1][n].get(x, 1.0)) for g in langs] for x in over]).reshape(-1, len(langs))
        contexts.append(hashed(over, n - 1, weight) if n > 1 else (np.zeros(1, np.uint64), weight))
    return Models(langs, alphabet, grams, contexts)


def hashed(names: list[str], n: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    h = ngram_hash(codes, n)[n - 1 :: n] if names else np.zeros(0, np.uint64)
    order = np.argsort(h)
    return h[order], table[order]


class Scorer:
    """Scores of distinct words, kept up to a bound."""

    def __init__(self, models: Models) -> None:
        self.models, self.place, self.table = models, {}, np.zeros((0, len(models.langs) + 1), np.float32)

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the log-probability in each language and characters; whether it has a letter."""
        lists = [_WORD.findall(t.lower()) if t else [] for t in texts]
        new = set().union(*lists).difference(self.place)
        if len(self.place) + len(new) > CACHE_WORDS:
            self.place, self.table = {}, self.table[:0]
            new = set().union(*lists)
        if new:
            words = list(new)
            self.place.update(zip(words, range(len(self.table), len(self.table) + len(words))))
            self.table = np.concatenate([self.table, self.models.word_scores(words)])
        size = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        rows = self.table[np.fromiter(map(self.place.__getitem__, chain.from_iterable(lists)), dtype=np.int64, count=int(size.sum()))]
        sums = np.vstack([np.zeros((1, rows.shape[1])), np.cumsum(rows, axis=0, dtype=np.float64)])
        end = np.cumsum(size)
        letters = np.array([any(map(str.isalpha, w)) or (bool(t) and any(map(str.isalpha, t))) for w, t in zip(lists, texts)], dtype=bool)
        return sums[end] - sums[end - size], letters


_SCORERS: dict[str, Scorer] = {}


def scorer_of(models: Models) -> Scorer:
    """The worker process keeps one scorer, that of the last models."""
    if models.name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[models.name] = Scorer(models)
    return _SCORERS[models.name]


def posterior(models: Models, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, its calibrated share, and its cross-entropy in bits a character."""
    bits = -sums[:, :-1] / np.maximum(sums[:, -1:], 1) / np.log(2)
    best = bits.argmin(axis=1)
    # evidence grows with the length, but characters of a text are not independent
    gain = (bits - bits[np.arange(len(bits)), best][:, None]) * np.sqrt(np.maximum(sums[:, -1:], 1)) * models.temperature
    return best, 1 / np.exp(-np.minimum(gain, 700)).sum(axis=1), bits[np.arange(len(bits)), best]


def fit(rows: list[tuple[str, str]], accuracy: float = 0.999) -> Models:
    """Models from (text, lang) rows: four fifths give counts, the rest the temperature and the rejection.

    A prediction is rejected if its share is below the least threshold at which accepted calibration rows reach
    ``accuracy``, or if its bits a character exceed all but a thousandth of the calibration rows' by half. With fewer
    than 20 calibration rows nothing is rejected but texts without letters.
    """
    words: dict[str, Counter] = defaultdict(Counter)
    for k, (text, lang) in enumerate(rows):
        if k % 5:
            words[lang].update(_WORD.findall(text.lower()))
    if not words:
        for text, lang in rows:
            words[lang].update(_WORD.findall(text.lower()))
    if not words:
        raise ValueError("no labelled text to learn from")
    models = build(words)
    held = [(t, g) for k, (t, g) in enumerate(rows) if k % 5 == 0 and g in words]
    sums, letters = Scorer(models).texts([t for t, _ in held]) if held else (np.zeros((0, len(models.langs) + 1)), np.zeros(0, bool))
    truth = np.array([models.langs.index(g) for _, g in held], dtype=int)
    ok = letters & (sums[:, -1] > 0)
    if ok.sum() >= 20:
        best = None
        for t in (0.03, 0.06, 0.12, 0.25, 0.5, 1, 2, 4, 8):
            models.temperature = t
            at, share, _ = posterior(models, sums[ok])
            right = at == truth[ok]
            loss = -np.log(np.clip(np.where(right, share, 1 - share), 1e-6, 1)).mean()
            if best is None or loss < best[0]:
                best = (loss, t)
        models.temperature = best[1]
        at, share, bits = posterior(models, sums[ok])
        order = np.argsort(-share)
        good = np.cumsum((at == truth[ok])[order]) / np.arange(1, len(order) + 1)
        enough = np.flatnonzero(good >= accuracy)
        models.accept = float(share[order][enough[-1]]) if len(enough) else 1.0
        models.most_bits = float(np.quantile(bits, 0.999) * 1.5)
    return models


def train(docs: DataFrame, most_docs: int = TRAIN_DOCS, most_chars: int = TRAIN_CHARS) -> Models:
    """Models from a bounded sample of labelled rows (doc_id, text, lang): ``most_docs`` a language of at most ``most_chars``."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= most_chars))
    rows = sorted((r.doc_id or 0, r.text, r.lang) for r in draw(usable, "lang", most_docs).select("doc_id", "text", "lang").collect())
    return fit([(t, g) for _, t, g in rows])


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """Per document (doc_id, text): lang_pred, score (0 to 1), bits_per_char, rejected.

    `und` with score 0, null bits and rejected if the text is null or has no letter. Ties go to the first language by
    name. Null and repeated doc_ids are rows like any other; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    given = spark.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = given.value
        scorer = scorer_of(m)
        for batch, texts in text_groups(batches):
            sums, letters = scorer.texts(texts)
            best, share, bits = posterior(m, sums)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([m.langs[b] if x else "und" for b, x in zip(best, letters)]), pa.array(np.where(letters, share, 0.0)), pa.array(bits, mask=~letters),
                 pa.array(~letters | (share < m.accept) | (bits > m.most_bits))], names=["doc_id", "lang_pred", "score", "bits_per_char", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, bits_per_char double, rejected boolean")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_char, rejected of every document; held-out rows are not learned from."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    models = train(docs.where(fold("doc_id", 4) != 2))
    return identify(docs, models).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "bits_per_char", "rejected")
