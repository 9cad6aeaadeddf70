"""Exact top-k inner products with a bit-sliced index.

Vectors are stored once in packed pieces, which are dealt to groups; each group's blocks are indexed once, and meet the
queries one packed piece after another. In a block every attribute is quantised to a few bits, and each bit of each attribute is a
bitmap over the block's rows. For a query, the slices weighted by its quantised components are added with carry-save
bitmap arithmetic, the k-th largest sum is found from the most significant slice downward, and all rows that could
still belong to the top, given the quantisation error, are resolved with exact integer products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, small_batches, stored

#: Rows of a stored piece, and of a block that is indexed as one.
PIECE, BLOCK = 4_096, 16_384
#: Rows that one task meets with every query; smaller tables are dealt to more tasks.
GROUP = 1 << 20
#: Bits of a quantised attribute, and of a quantised query component.
BITS, COEF = 6, 6


def add_slices(columns: dict[int, list[np.ndarray]], words: int) -> list[np.ndarray]:
    """Slices of the sum of bitmaps, each of which counts 2 ** weight for the rows it has; least significant first."""
    stacks = {w: np.concatenate([x if x.ndim == 2 else x[None] for x in v]) for w, v in columns.items() if v}
    out, w = [], 0
    while stacks:
        s = stacks.pop(w, None)
        if s is None:
            out.append(np.zeros(words, np.uint64))
            w += 1
            continue
        carry = [stacks.pop(w + 1)] if w + 1 in stacks else []
        while len(s) > 2:
            n = len(s) // 3
            a, b, c = s[:n], s[n : 2 * n], s[2 * n : 3 * n]
            x = a ^ b
            carry.append((a & b) | (x & c))
            s = np.concatenate([x ^ c, s[3 * n :]])
        if len(s) == 2:
            carry.append((s[0] & s[1])[None])
            out.append(s[0] ^ s[1])
        else:
            out.append(s[0])
        if carry:
            stacks[w + 1] = np.concatenate(carry)
        w += 1
    return out


def count(x: np.ndarray) -> int:
    return int(np.bitwise_count(x).sum())


def kth_largest(slices: list[np.ndarray], rows: np.ndarray, k: int) -> int:
    """The k-th largest of the sums of the given rows (a bitmap with k rows at least)."""
    value, left = 0, rows
    for i in range(len(slices) - 1, -1, -1):
        ones = left & slices[i]
        n = count(ones)
        if n >= k:
            value |= 1 << i
            left = ones
        else:
            k -= n
            left = left & ~slices[i]
    return value


def at_least(slices: list[np.ndarray], rows: np.ndarray, value: int) -> np.ndarray:
    """Bitmap of the rows whose sum is ``value`` or more."""
    if value <= 0:
        return rows
    if value >> len(slices):
        return np.zeros_like(rows)
    more, equal = np.zeros_like(rows), rows
    for i in range(len(slices) - 1, -1, -1):
        if value >> i & 1:
            equal = equal & slices[i]
        else:
            more = more | (equal & slices[i])
            equal = equal & ~slices[i]
    return more | equal


class BitSliced:
    """Index of a block: ids and integer vectors (rows, attributes)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.x = ids, x
        n, self.d = x.shape
        x = x.astype(np.int64)
        self.words = -(-n // 64)
        self.low = x.min(axis=0) if n else np.zeros(self.d, np.int64)
        span = (x.max(axis=0) - self.low) if n else self.low
        self.shift = np.maximum(np.array([int(s).bit_length() for s in span], dtype=np.int64) - BITS, 0)
        y = (x - self.low) >> self.shift
        self.slices = np.stack([self.bitmap(((y >> j) & 1).T.astype(bool)) for j in range(BITS)], axis=1) if n else np.zeros((self.d, BITS, 0), np.uint64)
        self.rows = self.bitmap(np.ones((1, n), bool))[0]

    def bitmap(self, bits: np.ndarray) -> np.ndarray:
        packed = np.packbits(bits, axis=1, bitorder="little")
        return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, self.words * 8 - packed.shape[1])))).view(np.uint64)

    def places(self, rows: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(rows.view(np.uint8), bitorder="little"))

    def top(self, own: int | None, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k rows with the largest exact products with q, but for the row at place ``own``; ties to smaller ids."""
        rows = self.rows
        if own is not None:
            rows = rows.copy()
            rows[own // 64] &= ~(np.uint64(1) << np.uint64(own % 64))
        if count(rows) > k:
            scaled = q << self.shift
            unit = max(1, -(-int(np.abs(scaled).max()) // ((1 << COEF) - 1)))
            c = np.round(scaled / unit).astype(np.int64)
            rest = scaled - unit * c
            top = (1 << BITS) - 1
            lost = (np.int64(1) << self.shift) - 1
            width = int((np.abs(q) * lost).sum() + (np.abs(rest) * top).sum())
            columns: dict[int, list[np.ndarray]] = {}
            for b in range(COEF):
                on = (np.abs(c) >> b) & 1 == 1
                for j in range(BITS):
                    up, down = on & (c > 0), on & (c < 0)
                    # a negative weight counts the complement, which adds a constant
                    columns.setdefault(b + j, []).extend([self.slices[up, j], ~self.slices[down, j]])
            sums = add_slices({w: [s for s in v if len(s)] for w, v in columns.items() if any(len(s) for s in v)}, self.words)
            if sums:
                rows = at_least(sums, rows, kth_largest(sums, rows, k) - -(-width // unit))
        at = self.places(rows)
        ids, score = self.ids[at], self.x[at].astype(np.int64) @ q
        order = np.lexsort((ids, -score))[:k]
        return ids[order], score[order]


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, x): floor(scale * component) of vectors without null or non-finite components."""
    v = F.col(vector_col)
    good = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(good).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("x"))


PACKED = "piece long, n int, d int, width int, ids binary, x binary"
ASKED = f"{PACKED}, places binary"


def packed(key: int, ids: np.ndarray, x: np.ndarray) -> list:
    """A row of PACKED: ids as 8-byte integers, the vectors in as few bytes a component as hold them."""
    top = int(np.abs(x).max(initial=0))
    width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    return [key, len(ids), x.shape[1], width, ids.astype(np.int64).tobytes(), x.astype(f"i{width}").tobytes()]


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["x"], dtype=f"i{row['width']}").reshape(row["n"], row["d"])


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}


def widened(x: np.ndarray, d: int) -> np.ndarray:
    """Rows with d components: zeros are added, or components cut that meet zeros alone."""
    return x[:, :d] if x.shape[1] >= d else np.pad(x, ((0, 0), (0, d - x.shape[1])))


def pieces(given: DataFrame, rows: int) -> DataFrame:
    """The vectors (id, x) in stored pieces of at most ``rows`` rows; a row is known by its piece and its place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 32
        for batch in batches:
            lists = batch.column(1)
            n = np.diff(lists.offsets.to_numpy())
            d = int(n.max(initial=0))
            x = np.zeros((batch.num_rows, d), dtype=np.int64)
            x[np.arange(d) < n[:, None]] = lists.flatten().to_numpy()
            ids = batch.column(0).to_numpy()
            for a in range(0, len(ids), rows):
                row = packed(key, ids[a : a + rows], x[a : a + rows])
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=[c.split()[0] for c in PACKED.split(", ")])
                key += 1

    small_batches(given.sparkSession, rows)
    return stored(given.mapInArrow(run, PACKED), "vectors")


def exact_top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest integer inner products, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but the query's own, other rows of
    its id included. Each row is a query of its own, so an id on r rows has r lists. Rows with a null id, a null vector,
    or a null or non-finite component take no part; a shorter vector counts as filled with zeros. Products must fit 63
    bits. Other columns are ignored; an empty table gives no rows.

    Vectors are shuffled once. Queries go to every group of GROUP rows, so that what moves grows with the rows at a given
    number of queries; a task holds one group and one piece of queries.
    """
    spark = vectors.sparkSession
    ship(spark)
    stock = pieces(quantised(vectors, id_col, vector_col, scale), PIECE)
    size = stock.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups = max(1, -(-size // GROUP), min(2 * spark.sparkContext.defaultParallelism, -(-size // PIECE)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                ids, x = unpacked(row)
                at = np.flatnonzero(ids % every == 0)
                if len(at):
                    cells = [*packed(row["piece"], ids[at], x[at]), at.astype(np.int64).tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(cells, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=[c.split()[0] for c in ASKED.split(", ")])

    small_batches(spark, 64)
    asked = stored(stock.mapInArrow(ask, ASKED), "queries")
    mine = stock.select(F.pmod(F.xxhash64("piece"), F.lit(groups)).alias("group"), F.lit(None).cast("binary").alias("places"), *stock.columns)
    theirs = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"), "places", *stock.columns)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, blocks, place = None, [], [], {}
        for batch in batches:
            for row in rows_of(batch):
                if row["group"] != group:
                    group, held, blocks, place = row["group"], [], [], {}
                ids, x = unpacked(row)
                if row["places"] is None:
                    held.append((row["piece"], ids, x))
                    continue
                if held and not blocks:
                    d = max(x_.shape[1] for *_, x_ in held)
                    starts = np.cumsum([0, *(len(i) for _, i, _ in held)])
                    place = {p: int(a) for (p, *_), a in zip(held, starts)}
                    all_ids, all_x = np.concatenate([i for _, i, _ in held]), np.concatenate([widened(x_, d) for *_, x_ in held])
                    blocks = [BitSliced(all_ids[a : a + BLOCK], all_x[a : a + BLOCK]) for a in range(0, len(all_ids), BLOCK)]
                    held = held[:1]
                if not blocks:
                    continue
                out: tuple[list, list, list, list, list] = ([], [], [], [], [])
                wide = widened(x.astype(np.int64), blocks[0].d)
                for q_id, at, q in zip(ids.tolist(), np.frombuffer(row["places"], dtype=np.int64).tolist(), wide, strict=True):
                    own = place[row["piece"]] + at if row["piece"] in place else -1
                    tops = [b.top(own - n * BLOCK if n * BLOCK <= own < n * BLOCK + len(b.ids) else None, q, k) for n, b in enumerate(blocks)]
                    found, score = (np.concatenate(c) for c in zip(*tops))
                    best = np.lexsort((found, -score))[:k]
                    for c, v in zip(out, (np.full(len(best), row["piece"]), np.full(len(best), at), np.full(len(best), q_id), found[best], score[best])):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in out], names=["piece", "place", "query_id", "vec_id", "score"])

    # a group's vectors come before its queries
    dealt = mine.union(theirs).repartition(groups, "group").sortWithinPartitions("group", F.col("places").isNotNull(), "piece")
    tops = dealt.mapInArrow(meet, "piece long, place long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("piece", "place").orderBy(F.desc("score"), "vec_id"))
    return tops.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_exact_top_k(spark, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: ten rows a query, over the whole table."""
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP8_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.r <> q.r
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY s.r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
