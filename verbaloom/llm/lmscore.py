"""Cross-entropy difference of two matched n-gram models.

Target and background models share the tokenizer's vocabulary, order, and smoothing; the background's counts are scaled
to the target's size. Each token of a document has a loss under either; the mean of their differences is its score
(lower: more like the target). Bigrams are counted exactly: their table grows with the corpus, stays distributed, and
is joined to the bigrams of each chunk of documents. A document's own counts are taken out of both models before they
score it, so it is judged by the others: a text that occurs only once does not vouch for itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, documents, shared_path, ship, small_batches, stored, text_groups
from .tokens import word_bpe

#: Strength of the unigram prior in a bigram's probability, and of the uniform one in a unigram's, in counts.
PRIOR, FLAT = 50.0, 0.5
#: Tokens of a chunk (a longer document is one of its own), and what a document counts besides its tokens.
CHUNK, EACH = 1 << 22, 16
#: Tokens of a slice of a chunk's documents that is scored at once (a longer document is one of its own).
SLICE = 1 << 19
#: Bytes of text in a bucket of chunks, and the most buckets that a table may have.
BUCKET, BUCKETS = 64_000_000, 100_000
#: Rows of bigrams that an Arrow batch holds.
PAIRS = 100_000


def keys(ids: np.ndarray, size: np.ndarray, start: int) -> np.ndarray:
    """(id before << 16 | id) of each token of texts of the given sizes; before a text's first one is ``start``."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    some = size[size > 0]
    before[np.cumsum(some) - some] = start
    return (before.astype(np.uint32) << np.uint32(16)) | ids


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    s = np.sort(values)
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]][: len(s)])
    return s[first], np.diff(np.r_[first, len(s)])


def chunks(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The documents in chunks: chunk, doc_ids, sizes (tokens), ids (little-endian unsigned 16-bit integers); bucketed by chunk."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe = word_bpe(tokenizer)
        if bpe.tokenizer.get_vocab_size() >= 1 << 16:
            raise ValueError("the vocabulary needs more than 16 bits")
        key, names, sizes, coded, weight = TaskContext.get().partitionId() << 32, [], [], [], 0

        def chunk() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([key], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([b"".join(coded)], pa.binary())],
                names=["chunk", "doc_ids", "sizes", "ids"],
            )

        for batch, texts in text_groups(batches):
            for name, x in zip(batch.column(0).to_pylist(), bpe.encode(texts), strict=True):
                ids = np.frombuffer(x, dtype=np.uint32).astype(np.uint16).tobytes()
                cost = len(ids) // 2 + EACH
                if names and weight + cost > CHUNK:
                    yield chunk()
                    key, names, sizes, coded, weight = key + 1, [], [], [], 0
                names.append(name)
                sizes.append(len(ids) // 2)
                coded.append(ids)
                weight += cost
        if names:
            yield chunk()

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "chunk long, doc_ids array<long>, sizes array<long>, ids binary")
    raw = int(docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0)
    return bucketed(made, shared_path(spark, "token-ids"), "chunk", min(BUCKETS, max(2 * spark.sparkContext.defaultParallelism, -(-raw // BUCKET))), "zstd")


def marked(coded: DataFrame, target: DataFrame) -> DataFrame:
    """The chunks with ``places``, those of their documents that are in the target (doc_id)."""
    places = coded.select("chunk", F.posexplode("doc_ids").alias("place", "doc_id"))
    # a target grows with the corpus, so it is never broadcast: one way at every size
    places = places.join(target.hint("merge"), "doc_id", "left_semi").groupBy("chunk").agg(F.collect_list("place").alias("places"))
    return coded.join(stored(places, "target-places").hint("merge"), "chunk", "left").select("chunk", "doc_ids", "sizes", "ids", "places")


def pairs(given: DataFrame, vocabulary: int) -> DataFrame:
    """(chunk, key, background, target) for each distinct bigram of each chunk: how often it occurs there in all documents, and in those of the target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                size = np.array(batch.column(1)[i].as_py(), dtype=np.int64)
                key = keys(np.frombuffer(batch.column(2)[i].as_py(), dtype=np.uint16), size, vocabulary)
                mine = np.zeros(len(size), dtype=bool)
                mine[batch.column(3)[i].as_py() or []] = True
                cell, n = distinct(key)
                some, m = distinct(key[np.repeat(mine, size)])
                t = np.zeros_like(n)
                t[np.searchsorted(cell, some)] = m
                for a in range(0, len(cell), PAIRS):
                    c = slice(a, a + PAIRS)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(cell[c]), batch.column(0)[i].as_py(), np.int64)), pa.array(cell[c].astype(np.int64)), pa.array(n[c].astype(np.int64)), pa.array(t[c].astype(np.int64))],
                        names=["chunk", "key", "background", "target"],
                    )

    small_batches(given.sparkSession)
    return stored(given.select("chunk", "sizes", "ids", "places").mapInArrow(run, "chunk long, key long, background long, target long"), "bigrams")


@dataclass
class Model:
    """What a model knows of single tokens: counts by id, and by id as a context (the start of a text is the last)."""

    one: np.ndarray
    context: np.ndarray

    def bits(self, key: np.ndarray, two: np.ndarray, own: tuple = (0, 0, 0, 0)) -> np.ndarray:
        """Loss in bits of each bigram (a key as ``keys`` gives it), given its exact count.

        ``own``: what to take out first, of the bigram, of its context, of its token, and of all tokens. The bigram's
        share of its context backs off to the token's share of all, and that to an even one, so that the probabilities of
        all tokens after a context sum to 1.
        """
        before, ids = key >> 16, key & 0xFFFF
        left = lambda all_, mine: np.maximum(all_ - mine, 0)
        one = (left(self.one[ids], own[2]) + FLAT) / (left(self.one.sum(), own[3]) + FLAT * len(self.one))
        return -np.log2((left(two, own[0]) + PRIOR * one) / (left(self.context[before], own[1]) + PRIOR))


def repeats(doc: np.ndarray, part: np.ndarray) -> np.ndarray:
    """How often each value of ``part`` occurs in its document."""
    _, at, n = np.unique(doc.astype(np.int64) << 32 | part.astype(np.int64), return_inverse=True, return_counts=True)
    return n[at]


def singles(counts: DataFrame, vocabulary: int) -> tuple[Model, Model, float]:
    """The single-token counts of target and background (scaled), and the scale of the latter; counts: (key, background, target)."""
    tables = []
    for part, n in ((F.col("key").bitwiseAND(0xFFFF), vocabulary), (F.shiftright("key", 16), vocabulary + 1)):
        # at most vocabulary + 1 rows
        got = counts.groupBy(part.cast("int").alias("id")).agg(F.sum("target").alias("target"), F.sum("background").alias("background")).toArrow()
        t = np.zeros((2, n))
        for k, name in enumerate(("target", "background")):
            t[k][got["id"].to_numpy()] = got[name].to_numpy()
        tables.append(t)
    one, context = tables
    size = np.maximum(1.0, one.sum(axis=1))
    scale = float(size[0] / size[1])
    return Model(one[0], context[0]), Model(one[1] * scale, context[1] * scale), scale


def score(given: DataFrame, counted: DataFrame, models: tuple[Model, Model, float], vocabulary: int) -> DataFrame:
    """Per document of the ``marked`` chunks: n_tokens, target_bits and background_bits (mean loss a token), score (their difference); null without tokens.

    ``counted`` has (chunk, key, background, target), with the corpus's counts, for every bigram of each chunk.
    """
    spark = given.sparkSession
    shared = spark.sparkContext.broadcast(models)
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("target_bits", pa.float64()), ("background_bits", pa.float64()), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        target, background, scale = shared.value
        cell = right["key"].to_numpy()
        order = np.argsort(cell)
        cell, two_target, two_all = cell[order].astype(np.uint32), right["target"].to_numpy()[order], right["background"].to_numpy()[order]
        parts = []
        for i in range(left.num_rows):
            names, sizes = left["doc_ids"][i].as_py(), np.array(left["sizes"][i].as_py(), dtype=np.int64)
            key_ = keys(np.frombuffer(left["ids"][i].as_py(), dtype=np.uint16), sizes, vocabulary)
            chosen = np.zeros(len(sizes), dtype=bool)
            chosen[left["places"][i].as_py() or []] = True
            stop, a = np.cumsum(sizes), 0
            while a < len(sizes):
                before = stop[a] - sizes[a]
                b = max(a + 1, int(np.searchsorted(stop, before + SLICE, side="right")))
                size, key = sizes[a:b], key_[before : stop[b - 1]].astype(np.int64)
                doc = np.repeat(np.arange(b - a), size)
                at = np.searchsorted(cell, key.astype(np.uint32))
                own = np.stack([repeats(doc, key), repeats(doc, key >> 16), repeats(doc, key & 0xFFFF), size[doc]]) if len(key) else np.zeros((4, 0))
                mine = own * chosen[a:b][doc]
                end, none, means = np.cumsum(size), size == 0, []
                for loss in (target.bits(key, two_target[at], tuple(mine)), background.bits(key, two_all[at] * scale, tuple(own * scale))):
                    total = np.r_[0.0, np.cumsum(loss)]
                    means.append((total[end] - total[end - size]) / np.maximum(size, 1))
                parts.append(pa.Table.from_arrays([pa.array(names[a:b], pa.int64()), pa.array(size), *(pa.array(x, mask=none) for x in (*means, means[0] - means[1]))], schema=out))
                a = b
        return pa.concat_tables(parts) if parts else out.empty_table()

    small_batches(spark, PAIRS)
    return given.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(run, "doc_id long, n_tokens long, target_bits double, background_bits double, score double")


def cross_entropy_difference(docs: DataFrame, target: DataFrame, tokenizer: str) -> DataFrame:
    """Score every document (doc_id, text) against the documents whose doc_id is in ``target``.

    Counts cover all tokens of all documents. A null or empty text has no tokens, and null losses and score; repeated
    doc_ids are rows of their own, and all in the target if their id is; a null id never is. Each row is scored by the
    counts of all rows but itself. Without any target tokens the target model is the uniform one. Other columns are
    ignored; an empty table gives no rows.
    """
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(tokenizer).get_vocab_size()
    coded = chunks(docs, tokenizer)
    given = marked(coded, target.select(F.col("doc_id").cast("long").alias("doc_id")).distinct())
    found = pairs(given, vocabulary)
    counts = stored(found.groupBy("key").agg(F.sum("background").alias("background"), F.sum("target").alias("target")), "bigram-counts")
    # one way at every size: the table of bigrams grows with the corpus
    counted = found.select("chunk", "key").join(counts.hint("merge"), "key")
    return score(given, counted, singles(counts, vocabulary), vocabulary)


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, target_bits, background_bits, score of every document; the target is the documents of quality 1."""
    import public_tokenizers

    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return cross_entropy_difference(documents(spark, sf_dir, "doc_id", "text"), good, public_tokenizers.path("word_bpe_49k.json"))
