"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints are bucketed so that any two within the distance share a bucket (pigeonhole over bit blocks). Inside a
bucket they are sorted by Gray rank; runs of neighbours form nodes that keep the bits all members share, upper nodes
take over what their children have in common, and a search adds up differences from the top down, pruning a whole
group as soon as its sum exceeds the distance. Each bucket reports a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, ship, small_batches, stored, text_groups, unused
from .graph import connected_components

#: Rows of a bucket that one task compares at once; larger buckets are dealt in pairs of parts.
PART = 4096
FAN = 8


def fingerprint(text: str | None, shingle: int) -> int:
    """64-bit SimHash of the word shingles (ASCII lower-cased, repeats included) of a text; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        return xxh64_intdigest(b" ".join(words), 42)
    n = len(words) - shingle + 1
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        part = words[at : at + (1 << 16) + shingle - 1]
        m = len(part) - shingle + 1
        h = np.fromiter(map(xxh64_intdigest, map(b" ".join, zip(*(part[i:] for i in range(shingle)))), repeat(42)), dtype=np.uint64, count=m)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp, text_hash) with fp as a signed long; null or empty texts have 0. text_hash tells rows of one doc_id apart."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_groups(batches):
            fp = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), batch.column(2)], names=["doc_id", "fp", "text_hash"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(make, "doc_id long, fp long, text_hash long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit word in the reflected Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class GrayIndex:
    """Hierarchy over fingerprints that are sorted by (group, Gray rank); groups do not share nodes."""

    def __init__(self, fp: np.ndarray, group: np.ndarray) -> None:
        n = len(fp)
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        self.levels = [(fp, np.full(n, full))]
        self.children: list[np.ndarray] = []
        ones, any_ = fp, fp
        while True:
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            place = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
            starts = np.flatnonzero(place % FAN == 0)
            ones, any_ = np.bitwise_and.reduceat(ones, starts), np.bitwise_or.reduceat(any_, starts)
            self.children.append(np.r_[starts, len(group)])
            group = group[starts]
            self.levels.append((ones, ~(ones ^ any_)))
            if len(group) == 1 or (group[1:] != group[:-1]).all():
                break
        # a child keeps the shared bits that its parent does not have
        for k in range(len(self.levels) - 1):
            pattern, mask = self.levels[k]
            up = np.repeat(self.levels[k + 1][1], np.diff(self.children[k]))
            self.levels[k] = (pattern, mask & ~up)
        self.root = np.repeat(np.arange(len(group)), np.diff(reduce(lambda at, c: c[at], self.children[::-1], np.arange(len(group) + 1))))

    def within(self, query: np.ndarray, node: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position in query, row) at most ``distance`` bits apart; node: the root to search for each query."""
        at = np.arange(len(query))
        spent = np.zeros(len(query), dtype=np.uint8)
        for k in range(len(self.levels) - 1, -1, -1):
            pattern, mask = self.levels[k]
            spent = spent + np.bitwise_count((query[at] ^ pattern[node]) & mask[node])
            keep = spent <= distance
            at, node, spent = at[keep], node[keep], spent[keep]
            if k:
                c = self.children[k - 1]
                n = c[node + 1] - c[node]
                shift = np.repeat(c[node] - np.r_[0, np.cumsum(n)[:-1]], n)
                node = shift + np.arange(len(shift))
                at, spent = np.repeat(at, n), np.repeat(spent, n)
        return at, node


def bucket_links(fp: np.ndarray, group: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within each group."""
    order = np.lexsort((gray_rank(fp), group))
    fp, group = fp[order], group[order]
    index = GrayIndex(fp, group)
    _, where, size = np.unique(group, return_inverse=True, return_counts=True)
    work = np.cumsum(size[where])
    label, at = np.arange(len(fp)), 0
    while at < len(fp):
        end = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + 2_000_000, side="right")))
        q, row = index.within(fp[at:end], index.root[at:end], distance)
        q = q + at
        keep = q < row
        label = components(len(fp), np.r_[label, label[q[keep]]], np.r_[np.arange(len(fp)), label[row[keep]]])
        at = end
    hung = np.flatnonzero(label != np.arange(len(fp)))
    return fp[hung], fp[label[hung]]


def masks(n: int, distance: int) -> list[int]:
    """Bit masks such that two words within the distance agree under one of them at least.

    The word is cut into distance + k blocks, of which k must agree; k grows with n, to keep buckets small.
    """
    for blocks in range(distance + 1, distance + 7):
        if n / 2 ** (64 * (blocks - distance) / blocks) <= 64:
            break
    cut = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cut, cut[1:])]
    return [sum(c) for c in combinations(block, blocks - distance)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(words: DataFrame, distance: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) that connect all which are within the distance of each other."""
    spark = words.sparkSession
    ship(spark)
    keys = words.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks(words.count(), distance)])).alias("t", "key"))
    large = keys.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > PART).select("t", "key", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    dealt = keys.join(large, ["t", "key"], "left").withColumn("mine", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")))
    cells = dealt.select("t", "key", "fp", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1), lambda x: F.least(x, F.col("mine")).cast("long") * 1048576 + F.greatest(x, F.col("mine"))))).alias("cell"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def found(rows: np.ndarray) -> pa.RecordBatch:
            new = np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)]
            a, b = bucket_links(np.ascontiguousarray(rows[:, 3]).view(np.uint64), np.cumsum(new), distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], axis=1))
            if sum(map(len, held)) >= 200_000:
                rows = np.concatenate(held)
                cut = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1))
                if len(cut):
                    yield found(rows[: cut[-1] + 1])
                    rows = rows[cut[-1] + 1 :]
                held = [rows]
        if rows_left := sum(map(len, held)):
            yield found(np.concatenate(held)) if rows_left else None

    return cells.repartition("t", "key", "cell").sortWithinPartitions("t", "key", "cell").select(F.col("t").cast("long").alias("t"), "key", "cell", "fp").mapInArrow(search, "a long, b long")


def rooted(fps: DataFrame, distance: int) -> DataFrame:
    """(fp, first, root) for each distinct fingerprint: its smallest doc_id, and one fingerprint for all of its component."""
    words = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected_components(links(words.select("fp"), distance))
    return words.join(roots, words.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): documents linked, directly or through others, at ``distance`` bits or fewer.

    component_id is the smallest doc_id of the component. A null text is an empty one (fingerprint 0, linked like any
    other); rows with a null doc_id count but give no name; repeated rows are kept. An empty table gives no rows.
    """
    fps = stored(fingerprints(docs, shingle), "fingerprints")
    named = rooted(fps, distance)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_word = named.join(least, "root").select("fp", "component_id")
    return fps.join(by_word, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """The documents, with all their columns, but one row of each component of ``near_duplicates``: that of the smallest doc_id.

    Ids must be integers, or text that holds them. Among rows of that doc_id, the one with the smallest text hash stays;
    rows equal in both are one. A row with a null doc_id stays only if no row of its component has an id. Null texts are
    empty ones. An empty table gives no rows.
    """
    fps = stored(fingerprints(docs, shingle), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    first = fps.groupBy("fp").agg(F.min(row).alias("row"))
    least = first.join(rooted(fps, distance).select("fp", "root"), "fp").groupBy("root").agg(F.min("row").alias("row"))
    return keep_rows(docs, least)


def keep_rows(docs: DataFrame, least: DataFrame) -> DataFrame:
    """The documents that ``least`` names (row: unnamed, doc_id, text_hash), each once, under any names of their columns.

    Texts are shuffled once and not sorted, unless rows are equal in id and text: those alone are then made distinct.
    """
    i, n, h = key = unused(docs.columns, "id_of_row", "unnamed_row", "hash_of_row")
    named = {i: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), n: F.col("doc_id").isNull(), h: F.xxhash64(F.col("text").cast("string"))}
    kept = least.select(F.coalesce("row.doc_id", F.lit(0)).alias(i), F.col("row.unnamed").alias(n), F.col("row.text_hash").alias(h))
    times = docs.select(*(c.alias(k) for k, c in named.items())).groupBy(*key).agg(F.count("*").alias("many")).where("many > 1").select(*key)
    often = stored(times.join(kept, key, "left_semi"), "equal-rows")
    mine = docs.withColumns(named)
    if often.isEmpty():
        return mine.join(kept.hint("shuffle_hash"), key, "left_semi").select(*docs.columns)
    once = mine.join(kept.join(often, key, "left_anti").hint("shuffle_hash"), key, "left_semi")
    one = mine.join(often.hint("shuffle_hash"), key, "left_semi").dropDuplicates(key)
    return once.union(one).select(*docs.columns)


def op4_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    from .common import documents

    found = near_duplicates(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
