"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur in a text with up to k edits. Cut into k + 1 pieces, it then has at least one piece that occurs
exactly. All pieces of all items are searched at once with an Aho-Corasick automaton; each hit gives the place where
the item would start, and Myers' bit-parallel distance verifies it there. Both sides are compared lower-cased, with
runs of ASCII white space and punctuation as one space.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, ship, small_batches, text_groups

#: Edits allowed for each character of a normalised item.
RATE = 0.06
#: Characters of test items that are searched in one pass; more items take more passes.
BLOCK_CHARS = 2_000_000
_FOLD = bytes(c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def normalised(text: str) -> str:
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) != len(text):
        raw = text.lower().encode("utf-8", "surrogatepass")
    return b" ".join(raw.translate(_FOLD).split()).decode("utf-8", "surrogatepass")


def myers(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of a pattern of m characters to any substring of text, and where the first such ends."""
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & mask
        mh = (mh << 1) & mask
        pv = mh | (~(xv | ph) & mask)
        mv = ph & xv
        if score < best:
            best, end = score, j
    return best, end


@dataclass
class Items:
    """Test items (id, normalised text) and the edits that each allows."""

    rows: list[tuple[int, str]]
    rate: float = RATE
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


class Matcher:
    def __init__(self, items: Items) -> None:
        import ahocorasick

        self.items = [(i, s, int(items.rate * len(s))) for i, s in items.rows if s]
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, s, k) in enumerate(self.items):
            cut = [len(s) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cut, cut[1:]):
                pieces[s[a:b]].append((n, b))
        self.automaton = ahocorasick.Automaton()
        for piece, at in pieces.items():
            self.automaton.add_word(piece, at)
        if pieces:
            self.automaton.make_automaton()
        self.any = bool(pieces)
        self.peq: dict[int, dict[str, int]] = {}

    def _peq(self, n: int) -> dict[str, int]:
        if n not in self.peq:
            out: dict[str, int] = defaultdict(int)
            for j, c in enumerate(self.items[n][1]):
                out[c] |= 1 << j
            self.peq[n] = dict(out)
        return self.peq[n]

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item id, least distance, end in the normalised text) of every item within its edits."""
        if not text or not self.any:
            return []
        s = normalised(text)
        starts: dict[int, set[int]] = defaultdict(set)
        for end, at in self.automaton.iter(s):
            for n, b in at:
                starts[n].add(end + 1 - b)
        out = []
        for n, places in starts.items():
            item, own, k = self.items[n]
            m = len(own)
            exact = s.find(own)
            if exact >= 0:
                out.append((item, 0, exact + m))
                continue
            best = (k + 1, 0)
            order = sorted(places)
            low = high = order[0]
            for p in [*order[1:], None]:
                if p is not None and p - high <= 2 * k:
                    high = p
                    continue
                # the item starts at most k from where a piece says it does
                begin = max(0, low - k)
                d, e = myers(self._peq(n), m, s[begin : high + m + k])
                best = min(best, (d, begin + e))
                low = high = p
            if best[0] <= k:
                out.append((item, *best))
        return sorted(out)


_MATCHERS: dict[str, Matcher] = {}


def matcher_of(items: Items) -> Matcher:
    """The worker process keeps one matcher, that of the last items."""
    if items.name not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[items.name] = Matcher(items)
    return _MATCHERS[items.name]


def blocks(benchmark: DataFrame, rate: float = RATE) -> list[Items]:
    """The test items (item_id, text), in blocks of bounded size by a hash of the item; null texts are left out."""
    spark = benchmark.sparkSession
    given = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    n = max(1, -(-int(given.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS))
    out = []
    for b in range(n):
        rows = sorted({(r.item_id if r.item_id is not None else -1, normalised(r.text)) for r in given.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()})
        out.append(Items(rows, rate))
    ship(spark)
    return out


MATCH = "doc_id long, item_id long, distance int, end long"


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, distance, end) for every test item that occurs in a document (doc_id, text) within its edits.

    One row a document row and item, with the least distance; an item of m normalised characters allows int(rate * m)
    edits, so one of under 1 / rate must occur exactly. An item may begin and end inside a word. Null and empty texts and
    items match nothing; a null item_id is -1; repeated items count once; other columns are ignored; an empty table of
    either gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items in blocks(benchmark, rate):
        given = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            matcher = matcher_of(given.value)
            for batch, texts in text_groups(batches):
                rows = [(i, *x) for i, t in zip(batch.column(0).to_pylist(), texts, strict=True) for x in matcher.find(t)]
                cols = zip(*rows, strict=True) if rows else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=["doc_id", "item_id", "distance", "end"])

        found = plain.mapInArrow(run, MATCH)
        out = found if out is None else out.union(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents, with all their columns, in whose text no test item occurs (as in ``matches``); nothing is shuffled."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    out = docs
    for items in blocks(benchmark, rate):
        given = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            matcher = matcher_of(given.value)
            for batch, texts in text_groups(batches):
                yield batch.filter(pa.array(np.array([not matcher.find(t) for t in texts], dtype=bool)))

        out = out.mapInArrow(run, docs.schema)
    return out


def op6_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """doc_id, item_id, distance, end of every benchmark item in every document."""
    return matches(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
