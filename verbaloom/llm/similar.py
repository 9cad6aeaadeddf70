"""Near-copies at a given Jaccard similarity, by SimHash with the Gray-order index and a verification on whole sets.

At a similarity of 0.8 two SimHashes differ in 15 of 100 bits, so the fingerprint is wide (256 bits, of the distinct
shingles), and buckets are bands of its bits: enough of them that a pair at the similarity shares one with the chance
``RECALL``. Inside a bucket the Gray-order index of operator 4 finds the members whose fingerprints are near. They are
linked into groups, and inside a group all pairs are verified on the whole shingle sets. So what is linked is exact, and
what is missed has a known small chance.

No step gives all pairs of a group. The first round tries, in the buckets of a few bands, the neighbours in Gray order alone:
that joins most of a large group, with links that are few for each set. The second searches the buckets of all bands and gives,
for the near pairs of different groups, one link a group. The verification gives one link a document that joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, ship, small_batches, stored, text_groups
from .graph import connected_components
from .simhash import GrayIndex, gray_rank, keep_rows

#: 64-bit words of a fingerprint, and the chance that a pair at exactly the similarity shares a band.
WORDS, RECALL = 4, 0.9995
#: Sets of so many shingles are small: halves of few hashes are coarse, and up to this share of bits differs (5 shingles and 4 of them).
SMALL, COARSE = 20, 0.1875
#: Rows that a bucket of unlike texts holds on average, and members of a bucket that are compared at once.
BUCKET, PART = 64, 4096
#: Bands in whose buckets neighbours are linked before all bands are searched: at most 2 * FIRST links for each set.
FIRST = 8
#: Sets of a group, and their shingles, that are verified at once.
SETS, SHINGLES = 4096, 2_000_000
#: Further columns that tell members apart: the other words of the fingerprint and the size of the set.
FURTHER = ("third", "fourth", "n")
_R = np.random.Generator(np.random.PCG64(80))
FLIP = _R.integers(0, 1 << 64, WORDS, dtype=np.uint64)
TIMES = _R.integers(0, 1 << 64, WORDS, dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles (ASCII lower-cased); a shorter text is one shingle, one without words has none."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    k = min(k, len(words))
    return np.unique(np.fromiter((xxh64_intdigest(b" ".join(g)) for g in zip(*(words[i:] for i in range(k)))), dtype=np.uint64, count=len(words) - k + 1))


def wide_fingerprint(values: np.ndarray) -> np.ndarray:
    """WORDS 64-bit words: a bit is 1 if it is set in over half the hashes."""
    counts = np.zeros(64 * WORDS, dtype=np.int64)
    for a in range(0, len(values), 4096):
        h = values[a : a + 4096, None] ^ FLIP
        h = h * TIMES
        h ^= h >> np.uint64(32)
        h = h * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        counts += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(values), bitorder="little").view(np.uint64)


def differing(similarity: float) -> float:
    """Share of bits that differ, on average, between the SimHashes of sets at the similarity (unequal sizes: fewer)."""
    return acos(2 * similarity / (1 + similarity)) / pi


def radius(similarity: float, bits: int) -> int:
    """Bits that may differ: four standard deviations over the average, or three over that of small sets, whichever is more."""
    over = lambda p, k: ceil(bits * p + k * (bits * p * (1 - p)) ** 0.5)
    return min(bits, max(over(differing(similarity), 4), over(max(differing(similarity), COARSE), 3)))


def bands(n: int, similarity: float) -> tuple[np.ndarray, int]:
    """(bands, bits), the bits of each band, and how many of the bands large sets use; small ones use all.

    Bands get longer as n grows, so that buckets of unlike texts stay small, and more, so that RECALL holds.
    """
    length = max(12, ceil(log2(max(n, 1) / BUCKET)))
    number, more = (ceil(log(1 - RECALL) / log(1 - (1 - p) ** length)) for p in (differing(similarity), max(differing(similarity), COARSE)))
    r = np.random.Generator(np.random.PCG64(length))
    return np.stack([r.permutation(64 * WORDS)[:length] for _ in range(more)]), number


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text_hash, node, n, wide): node is a hash of the whole shingle set, n its size, wide its fingerprint."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch, texts in text_groups(batches):
            sets = [shingles(t, shingle) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.array([xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([wide_fingerprint(s).tobytes() for s in sets], pa.binary())], names=["doc_id", "text_hash", "node", "n", "wide"])

    text = F.col("text").cast("string")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return given.mapInArrow(make, "doc_id long, text_hash long, node long, n long, wide binary")


def gray_word(rank: np.ndarray) -> np.ndarray:
    """The 64-bit word at a place in the reflected Gray sequence."""
    return rank ^ (rank >> np.uint64(1))


def near(words: list[np.ndarray], sizes: np.ndarray | None, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether members a and b are near by the first two words and by all, and their sizes (where given) allow the similarity."""
    ok = np.bitwise_count(words[0][a] ^ words[0][b]) + np.bitwise_count(words[1][a] ^ words[1][b]) <= radius(similarity, 128)
    if sizes is not None:
        ok &= np.minimum(sizes[a], sizes[b]) >= np.maximum(sizes[a], sizes[b]) * (similarity - 1e-9)
    if len(words) > 2:
        a, b = a[ok], b[ok]
        ok[ok] = sum(np.bitwise_count(w[a] ^ w[b]).astype(np.int64) for w in words) <= radius(similarity, 64 * len(words))
    return ok


def members(sets: DataFrame, similarity: float) -> DataFrame:
    """(key, rank, node, more, third, fourth, n), and root if the sets have it: each set once a band; key names the band and
    its bits, rank is the place of the fingerprint's first word in Gray order, more, third and fourth are its other words."""
    spark = sets.sparkSession
    places, number = bands(sets.count(), similarity)
    weight = np.uint64(1) << np.arange(places.shape[1], dtype=np.uint64)
    root = [c for c in sets.columns if c == "root"]
    names = ["key", "rank", "node", "more", *FURTHER, *root]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            wide = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint64).reshape(-1, WORDS)
            bits = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little")
            cols = [gray_rank(wide[:, 0]), batch.column(0).to_numpy(), *wide[:, 1:].T, *(batch.column(k).to_numpy() for k in range(2, 3 + len(root)))]
            small = cols[5] <= SMALL
            for t, at in enumerate(places):
                if t == number:
                    bits, cols = bits[small], [c[small] for c in cols]
                key = bits[:, at] @ weight ^ np.uint64(t) << np.uint64(48)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for c in (key.astype(np.uint64), *cols)], names=names)

    small_batches(spark, 8192)
    return sets.select("node", "wide", "n", *root).mapInArrow(run, ", ".join(f"{c} long" for c in names))


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("many", pa.int64())])


def pairs_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(a), pa.int64())], schema=PAIR)


def neighbours(rows: DataFrame, similarity: float, first_bands: int = FIRST) -> DataFrame:
    """(a, b, many): members of a bucket that follow one another in Gray order, or its first, and are near by the words given.

    Only buckets of the first bands are looked at: in those of other bands a set of a large group has other neighbours each
    time, links that join nothing new. What is not joined yet ``across`` joins, in the buckets of all bands.

    A task streams its rows, and a large bucket may lie in several tasks. Rows with ``many`` are counts instead: of the
    bucket with key a, the members in one task, where they are over PART or the bucket may go on in another task.
    """
    further = [c for c in FURTHER if c in rows.columns]
    sized = "n" in further

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = first = None
        count, begun = 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            key, rank, node, *rest = (batch.column(k).to_numpy().astype(np.int64) for k in range(4 + len(further)))
            own = (key, gray_word(rank.view(np.uint64)), node, *(c.view(np.uint64) for c in rest))
            old = 0 if last is None else 2
            if old:
                own = tuple(np.r_[x, y, z] for x, y, z in zip(first, last, own))
            key, fp, node, *rest = own
            words, sizes = ([fp, *rest[:-1]], rest[-1]) if sized else ([fp, *rest], None)
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            lead = np.repeat(new, np.diff(np.r_[new, len(key)]))
            mine = np.flatnonzero(key >> 48 < first_bands)
            for other in (lead[mine], np.maximum(mine - 1, 0)):
                found = (key[mine] == key[other]) & (node[mine] != node[other]) & near(words, sizes, mine, other, similarity)
                yield pairs_batch(node[mine[found]], node[other[found]])
            held = np.diff(np.r_[new, len(key)])
            held[0] += count - old
            for k, n in zip(new[:-1].tolist(), held[:-1].tolist()):
                if n > PART or begun:
                    yield pa.RecordBatch.from_arrays([pa.array([key[k]]), pa.array([0], pa.int64()), pa.array([n], pa.int64())], schema=PAIR)
                begun = False
            count = int(held[-1])
            last = tuple(x[-1:] for x in own)
            first = tuple(x[lead[-1] : lead[-1] + 1] for x in own)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array(last[0]), pa.array([0], pa.int64()), pa.array([count], pa.int64())], schema=PAIR)

    return rows.select("key", "rank", "node", "more", *further).repartitionByRange("key", "rank").sortWithinPartitions("key", "rank").mapInArrow(run, "a long, b long, many long")


def across(rows: DataFrame, large: DataFrame, similarity: float, joined: bool = False) -> DataFrame:
    """(a, b): members of a bucket (key, rank, node, more, root) that are near by the words given and of different roots.

    With ``joined``, the links of those roots instead: each root with the smallest that such pairs join it to among the
    rows at hand, so there are fewer links than roots.
    Of the buckets in ``large`` (key, many), the members of the commonest root are dealt to parts, and the others go to every part.
    """
    first = radius(similarity, 64)
    further = [c for c in FURTHER if c in rows.columns]
    sized = "n" in further
    common = rows.join(large, "key").groupBy("key").agg(F.mode("root").alias("common"), F.max("many").alias("many"))
    parts = F.ceil(F.col("many") / PART).cast("int")
    dealt = rows.join(stored(common, "large-buckets"), "key", "left").withColumn("cells", F.when(F.col("common").isNull(), F.array(F.lit(0))).when(F.col("root") == F.col("common"), F.array(F.pmod(F.xxhash64("node"), parts).cast("int"))).otherwise(F.sequence(F.lit(0), parts - 1)))
    cells = dealt.select("key", F.explode("cells").alias("cell"), "rank", "node", "root", "more", *further)

    def found(rows: np.ndarray) -> pa.RecordBatch:
        key, node, root = rows[:, :2], rows[:, 3], rows[:, 4]
        fp, *rest = (np.ascontiguousarray(rows[:, k]).view(np.uint64) for k in (2, *range(5, rows.shape[1])))
        fp = gray_word(fp)
        words, sizes = ([fp, *rest[:-1]], rest[-1]) if sized else ([fp, *rest], None)
        group = np.cumsum(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        index = GrayIndex(fp, group)
        # only members that are not of their group's commonest root search: each pair across roots has such a one
        _, kind = np.unique(np.stack([group, root], axis=1), axis=0, return_inverse=True)
        times = np.bincount(kind)[kind]
        top = np.maximum.reduceat(times, np.flatnonzero(np.r_[True, group[1:] != group[:-1]]))[group - 1]
        lead = np.zeros(group[-1] + 1, dtype=np.int64)
        lead[group[times == top]] = kind[times == top]
        ask = np.flatnonzero(kind != lead[group])
        out_a, out_b = [], []
        for a in range(0, len(ask), 20_000):
            mine = ask[a : a + 20_000]
            q, r = index.within(fp[mine], index.root[mine], first)
            q = mine[q]
            keep = (root[q] != root[r]) & near(words, sizes, q, r, similarity)
            a_, b_ = (root[q[keep]], root[r[keep]]) if joined else (node[q[keep]], node[r[keep]])
            out_a.append(a_)
            out_b.append(b_)
        none = np.zeros(0, np.int64)
        a, b = np.concatenate([none, *out_a]), np.concatenate([none, *out_b])
        if joined:
            ends, at = np.unique(np.r_[a, b], return_inverse=True)
            low = components(len(ends), at[: len(a)], at[len(a) :])
            tied = np.flatnonzero(low != np.arange(len(ends)))
            a, b = ends[tied], ends[low[tied]]
        return pairs_batch(a, b).select(["a", "b"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(6 + len(further))], axis=1))
            if sum(map(len, held)) >= 200_000:
                rows = np.concatenate(held)
                cut = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1))
                if len(cut):
                    yield found(rows[: cut[-1] + 1])
                    rows = rows[cut[-1] + 1 :]
                held = [rows]
        if sum(map(len, held)):
            yield found(np.concatenate(held))

    return cells.repartition("key", "cell").sortWithinPartitions("key", "cell", "rank").mapInArrow(search, "a long, b long")


def links_of_sets(sets: list[np.ndarray], ask: np.ndarray, told: np.ndarray, root: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs (of those that ask with those that are told) that have the similarity, one for each time two roots become one.

    An inverted index holds of each set only so many of its rarest shingles that two similar sets share one of them.
    """
    size = np.array([len(s) for s in sets])
    start = np.r_[0, np.cumsum(size)]
    _, ids, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(often), dtype=np.int64)
    place[np.argsort(often, kind="stable")] = np.arange(len(often))
    owner = np.repeat(np.arange(len(sets)), size)
    ids = place[ids]
    ids = ids[np.lexsort((ids, owner))]
    rare = size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1
    kept = np.flatnonzero((np.arange(len(ids)) - start[owner] < rare[owner]) & told[owner])
    kept = kept[np.argsort(ids[kept], kind="stable")]
    post, at = owner[kept], np.searchsorted(ids[kept], np.arange(len(often) + 1))
    _, label = np.unique(root, return_inverse=True)
    mine, out = np.zeros(len(often), dtype=bool), []
    for i in np.flatnonzero(ask):
        own = ids[start[i] : start[i + 1]]
        j = np.unique(np.concatenate([post[at[k] : at[k + 1]] for k in own[: rare[i]]]))
        # two that both ask and are told meet once
        j = j[(label[j] != label[i]) & (np.minimum(size[j], size[i]) >= np.maximum(size[j], size[i]) * (similarity - 1e-9)) & ((j < i) | ~ask[j] | ~told[i])]
        mine[own] = True
        for k in j.tolist():
            if label[k] != label[i]:
                common = np.count_nonzero(mine[ids[start[k] : start[k + 1]]])
                if common >= similarity * (size[i] + size[k] - common) - 1e-9:
                    label[label == label[k]] = label[i]
                    out.append((int(i), k))
        mine[own] = False
    return out


def linked(cells: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs inside a cell (group, cell, ask, told, node, root, set) that have the similarity; see ``links_of_sets``."""

    def found(rows: list[tuple]) -> pa.RecordBatch:
        ask, told, node, root, sets = zip(*rows)
        pairs = links_of_sets([np.frombuffer(s, dtype=np.uint64) for s in sets], np.array(ask), np.array(told), np.array(root), similarity) if len(rows) > 1 else []
        node = np.array(node, dtype=np.int64)
        return pairs_batch(*(node[[p[k] for p in pairs]] if pairs else np.zeros(0, np.int64) for k in (0, 1))).select(["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, {}
        for batch in batches:
            for group, cell, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (group, cell) != last and held:
                    yield found(list(held.values()))
                    held = {}
                last = group, cell
                # rows with one id and one text made the same set more than once
                held[tuple(row[:3])] = row
        if held:
            yield found(list(held.values()))

    small_batches(cells.sparkSession)
    return cells.select("group", "cell", "ask", "told", "node", "root", "set").repartition("group", "cell").sortWithinPartitions("group", "cell").mapInArrow(run, "a long, b long")


def verified(groups: DataFrame, docs: DataFrame, sets: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Pairs (a, b) inside the groups (node, group) that have the similarity: enough to link what all such pairs link.

    Only the sets of documents in a group are made again, from their texts. A large group is dealt to cells by hash; then
    all that its commonest component does not hold are compared with all its sets, in cells again.
    """
    needed = groups.join(sets, "node").select("node", "group", F.coalesce("row.doc_id", F.lit(0)).alias("id"), F.col("row.unnamed").alias("unnamed"), F.col("row.text_hash").alias("hash"))
    text = F.col("text").cast("string")
    mine = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("unnamed"), F.xxhash64(text).alias("hash"), text.alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_groups(batches):
            made = [shingles(t, shingle) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in made], pa.int64()), pa.array([s.tobytes() for s in made], pa.binary())], names=["node", "group", "n", "set"])

    small_batches(docs.sparkSession)
    made = stored(mine.join(needed.hint("shuffle_hash"), ["id", "unnamed", "hash"]).select("node", "group", "text").mapInArrow(make, "node long, group long, n long, set binary"), "sets", "none")
    cells = lambda count, total: F.ceil(F.greatest(F.col(count) / SETS, F.col(total) / SHINGLES)).cast("int")
    sizes = stored(made.groupBy("group").agg(F.count("*").alias("rows"), F.sum("n").alias("total")).withColumn("parts", cells("rows", "total")), "groups")
    part = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("long")
    inside = stored(linked(made.join(sizes, "group").withColumns({"cell": part("parts"), "ask": F.lit(True), "told": F.lit(True), "root": F.col("node")}), similarity), "near-copies")
    large = sizes.where("parts > 1").select("group", "parts")
    if large.isEmpty():
        return inside
    placed = made.join(large, "group").join(connected_components(inside), "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = placed.groupBy("group", "root").agg(F.count("*").alias("rows"), F.sum("n").alias("total"))
    most = F.max(F.struct("rows", "total", "root"))
    common = roots.groupBy("group").agg(F.sum("rows").alias("rows"), F.sum("total").alias("total"), most.alias("most"))
    rest = common.select("group", F.col("most.root").alias("common"), (F.col("rows") - F.col("most.rows")).alias("rows"), (F.col("total") - F.col("most.total")).alias("total")).where("rows > 0").withColumn("askers", cells("rows", "total"))
    placed = placed.join(stored(rest.select("group", "common", "askers"), "commonest"), "group")
    every = lambda of, cell: F.explode(F.transform(F.sequence(F.lit(0), F.col(of) - 1), cell))
    asking = placed.where("root <> common").withColumns({"ask": F.lit(True), "told": F.lit(False), "cell": every("parts", lambda x: part("askers") * F.col("parts") + x)})
    telling = placed.withColumns({"ask": F.lit(False), "told": F.lit(True), "cell": every("askers", lambda x: x * F.col("parts") + part("parts"))})
    return inside.union(stored(linked(asking.unionByName(telling), similarity), "near-copies"))


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(sets, roots): the distinct shingle sets (node, row, n, wide), row being the least (unnamed, doc_id, text_hash) that
    has the set, and (node, root) of the sets that have a near-copy, directly or through others."""
    made = stored(sketches(docs, shingle), "sketches")
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    sets = stored(made.groupBy("node").agg(F.min(row).alias("row"), F.first("n").alias("n"), F.first("wide").alias("wide")), "shingle-sets")
    # smaller sets are never similar to another one, even with one shingle more
    searched = sets.where(F.col("n") >= (F.col("n") + 1) * (similarity - 1e-9))
    close = stored(neighbours(members(searched, similarity), similarity), "neighbours")
    links = close.where("many is null").select("a", "b")
    roots = stored(connected_components(links), "roots")
    placed = stored(searched.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    large = stored(close.where("many is not null").groupBy(F.col("a").alias("key")).agg(F.sum("many").alias("many")).where(F.col("many") > PART), "large-keys")
    more = stored(across(members(placed, similarity), large, similarity, joined=True), "links")
    groups = stored(connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)).withColumnRenamed("root", "group"), "groups")
    return sets, connected_components(verified(groups, docs, sets, shingle, similarity))


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents, with all their columns, but one row of each component of near-copies, as ``simhash.keep_one`` chooses it.

    Near-copies have a Jaccard similarity of ``similarity`` or more of their sets of ``shingle`` words, directly or
    through others. Null texts and texts without words are near-copies of each other; an empty table gives no rows.
    """
    sets, roots = near_copies(docs, shingle, similarity)
    least = sets.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("row").alias("row"))
    return keep_rows(docs, least)
