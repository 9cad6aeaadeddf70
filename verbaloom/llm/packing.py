"""Best-fit packing: best-two-fit over a histogram of lengths.

A packing plan depends on how many pieces there are of each length, and lengths are integers up to the capacity.
So the plan is made from a histogram of at most ``capacity`` counts, whatever the corpus size, as bin patterns with
multiplicities; each piece then finds its bin from its rank among the pieces of its length. No group of pieces is
ever gathered in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, small_batches, stored, text_groups
from .tokens import word_bpe


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-two-fit: (number of equal bins, [(length, how many of it in each bin)]) covering all counts.

    A bin is filled greedily, the largest unpacked length that fits first. Then its smallest item gives way to two
    unpacked items if those fill the expanded gap more tightly. The bin is repeated while its lengths last, so each
    round uses up a length (or leaves fewer of it than one bin took).
    """
    left = {k: v for k, v in counts.items() if v > 0}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError("lengths must be from 1 to the capacity")
    present = sorted(left)
    plan = []
    while present:
        used: dict[int, int] = {}
        gap, at = capacity, len(present)
        while gap > 0:
            at = min(at, bisect_right(present, gap))
            if not at:
                break
            size = present[at - 1]
            n = min(left[size] - used.get(size, 0), gap // size)
            if n:
                used[size] = used.get(size, 0) + n
                gap -= n * size
            at -= 1
        if gap:
            small = min(used)
            room = gap + small
            fits = np.array(present[: bisect_right(present, room - 1)], dtype=np.int64)
            fits = fits[[left[x] - used.get(x, 0) > 0 for x in fits.tolist()]] if len(fits) else fits
            if len(fits):
                other = np.searchsorted(fits, room - fits, side="right") - 1
                mine = np.arange(len(fits))
                twice = np.array([left[x] - used.get(x, 0) > 1 for x in fits.tolist()])
                ok = (other > mine) | ((other == mine) & twice)
                total = np.where(ok, fits + fits[np.maximum(other, 0)], 0)
                best = int(total.argmax())
                if total[best] > small:
                    used[small] -= 1
                    for x in (int(fits[best]), int(fits[other[best]])):
                        used[x] = used.get(x, 0) + 1
                    used = {k: v for k, v in used.items() if v}
        times = min(left[k] // v for k, v in used.items())
        plan.append((times, sorted(used.items(), reverse=True)))
        for k, v in used.items():
            left[k] -= times * v
            if not left[k]:
                del left[k]
                present.remove(k)
    return plan


def placements(plan: list[tuple[int, list[tuple[int, int]]]], capacity: int) -> dict[str, np.ndarray]:
    """For each length and range of ranks within it: first bin, items of that length in a bin, their first offset."""
    rows, taken, first_bin = [], {}, 0
    for times, items in plan:
        offset = 0
        for size, n in items:
            begin = taken.get(size, 0)
            rows.append((size, begin, first_bin, n, offset))
            taken[size] = begin + times * n
            offset += size * n
        first_bin += times
    rows.sort()
    out = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return {"size": out[:, 0], "begin": out[:, 1], "bin": out[:, 2], "n": out[:, 3], "offset": out[:, 4]}


PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("rank", T.LongType()),
    ]
)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Token pieces of each document: its ids and ``end_id``, cut at every ``capacity`` ids. Not yet placed.

    A null or empty text is ``end_id`` alone. Rows with a null or repeated doc_id are packed like any other.
    ``part`` and ``rank`` number the pieces of one length within the task that made them.
    """
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    end = end_id.to_bytes(4, "little")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, seen = word_bpe(tokenizer), TaskContext.get().partitionId(), [0] * (capacity + 1)
        step = 4 * capacity
        for batch, texts in text_groups(batches):
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), bpe.encode(texts), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    cut = ids[at : at + step]
                    n = len(cut) // 4
                    rows.append((doc, k, at // 4, n, zlib.crc32(cut), part, seen[n]))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)],
                names=PIECES.names,
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(make, PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack documents (doc_id, text; more columns are ignored) into sequences of at most ``capacity`` tokens.

    One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is its end token
    alone; rows with null or repeated doc_ids are documents like any other. Which of several pieces of one length goes
    where is settled by their task and their place in it. An empty table gives no rows.
    """
    made = stored(pieces(docs, tokenizer, capacity, end_id), "pieces")
    by_part = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = by_part.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # at most ``capacity`` rows
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = placements(plan_bins(counts, capacity), capacity)
    shift = np.int64(1) << np.int64(44)
    key = where["size"] * shift + where["begin"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "nth"))
            at = np.searchsorted(key, size * shift + rank, side="right") - 1
            over = rank - where["begin"][at]
            n = where["n"][at]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in range(5)), pa.array(where["bin"][at] + over // n), pa.array(where["offset"][at] + over % n * size)], names=[*PIECES.names[:5], "sequence_id", "offset"]
            )

    ranked = made.join(before.select("part", "length", "before"), ["part", "length"]).select(*PIECES.names[:5], (F.col("rank") + F.col("before")).alias("nth"))
    return ranked.mapInArrow(place, T.StructType([*PIECES.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    import public_tokenizers

    from .common import documents

    return pack(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
