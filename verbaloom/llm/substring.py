"""Substring dedup with a log-structured index of window fingerprints.

The log (``WindowLog``) takes documents in batches. A batch's texts are packed once into chunks (a table bucketed by chunk
key, so that later joins on the key move no text), and its fingerprints become one sorted immutable run: anchors, that is,
of every W consecutive words the shorter shingle with the least hash (winnowing). Equal windows always have equal
anchors, and only about a tenth of all positions is one. Runs are merge-joined by hash range, and compacted to one when
there are more than ``fan``.

A batch is judged against the whole log, itself included, in two rounds. The merge finds the anchors that start more than
once, and the chunks that hold them. In these chunks, of earlier batches too, the windows around such anchors are then
verified: by a 128-bit BLAKE2b digest of the window's own words, not by the hashes that found them. A range holds a value
at most twice for each chunk, so a passage that a third of all documents share is no larger there than any other.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucketed, shared_path, ship, small_batches, stored

#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK = 8_000_000
#: Bytes of text for each hash range; small inputs have smaller ranges, so that they too are dealt to many tasks.
RANGE, SMALL_RANGE, MANY_RANGES = 8_000_000, 250_000, 10
#: Bytes of text in a bucket of chunks, and the most buckets that a table may have.
BUCKET, BUCKETS = 64_000_000, 100_000
#: Batches that a table is dealt into where the caller gives no log.
BATCHES = 2
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
B1 = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def ahead(x: np.ndarray, n: int, fill: int) -> np.ndarray:
    """x[i + n] at i."""
    out = np.full_like(x, fill)
    if n < len(x):
        out[: len(x) - n] = x[n:]
    return out


def rolled(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """Polynomial hash of h[i : i + k] at i, by doubling."""
    block, size, out, have = h, 1, None, 0
    while k:
        if k & 1:
            out = block if out is None else out + ahead(block, have, 0) * np.uint64(pow(base, have, 1 << 64))
            have += size
        k >>= 1
        if k:
            block = block + ahead(block, size, 0) * np.uint64(pow(base, size, 1 << 64))
            size *= 2
    return mix(out)


def least(x: np.ndarray, k: int) -> np.ndarray:
    """min(x[i : i + k]) at i."""
    size = 1
    while size * 2 <= k:
        x = np.minimum(x, ahead(x, size, int(NONE)))
        size *= 2
    return np.minimum(x, ahead(x, k - size, int(NONE))) if k > size else x


class Words:
    """Word hashes of a chunk's texts, one after another, and what follows from them."""

    def __init__(self, texts: list[bytes | None], window: int) -> None:
        from xxhash import xxh64_intdigest

        self.texts, self.window, self.anchor = texts, window, window - window // 2
        h, n = [], []
        for t in texts:
            w = t.split() if t else []
            n.append(len(w))
            h.append(np.fromiter(map(xxh64_intdigest, w), dtype=np.uint64, count=len(w)))
        self.counts = np.array(n, dtype=np.int64)
        self.h = np.concatenate(h) if h else np.zeros(0, np.uint64)
        left = np.repeat(np.cumsum(self.counts), self.counts) - np.arange(len(self.h))
        self.starts = left >= window
        v = rolled(self.h, self.anchor, B1)
        v[v == NONE] = 0
        self.v = np.where(left >= self.anchor, v, NONE)
        self.low = least(self.v, window - self.anchor + 1)
        low = np.where(self.starts, self.low, 0)
        top = ~least(~low[::-1], window - self.anchor + 1)[::-1]
        self.chosen = (top == self.v) & (self.v != NONE)

    def anchors(self) -> np.ndarray:
        return self.v[self.chosen]

    def windows(self, repeated: np.ndarray) -> np.ndarray:
        """Starts of the windows whose anchor is repeated."""
        v = np.full_like(self.v, NONE)
        where = np.flatnonzero(self.chosen)[repeated]
        v[where] = self.v[where]
        return np.flatnonzero(self.starts & (least(v, self.window - self.anchor + 1) == self.low))

    def digests(self, at: np.ndarray) -> np.ndarray:
        """128 bits of the words of each window, joined by a space, as two 64-bit words."""
        out, end = [], np.cumsum(self.counts)
        cut = np.searchsorted(at, np.r_[0, end])
        for k, t in enumerate(self.texts):
            mine = at[cut[k] : cut[k + 1]] - (end[k] - self.counts[k])
            if len(mine):
                words = t.split()
                first = np.cumsum([0, *(len(w) + 1 for w in words)])
                joined = b" ".join(words)
                out += [hashlib.blake2b(joined[a:b], digest_size=16).digest() for a, b in zip(first[mine].tolist(), (first[mine + self.window] - 1).tolist())]
        return np.frombuffer(b"".join(out), dtype=np.uint64).reshape(-1, 2)

    def covered(self, at: np.ndarray) -> np.ndarray:
        step = np.zeros(len(self.h) + 1, dtype=np.int32)
        np.add.at(step, at, 1)
        np.add.at(step, at + self.window, -1)
        return np.cumsum(step[:-1]) > 0


def chunks(docs: DataFrame, keep: Sequence[str], batch: int, raw: int, path: str) -> DataFrame:
    """The texts (``raw`` bytes in all) in chunks: key, ids, lens (-1: null), raw (bytes), blob (zstd), rest (other columns, Arrow); bucketed by key."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        key = (batch << 48) + (TaskContext.get().partitionId() << 24)
        pack = zstandard.ZstdCompressor(level=3)
        ids: list = []
        texts: list = []
        raw = 0
        rest: list[pa.RecordBatch] = []

        def chunk() -> pa.RecordBatch:
            others = pa.Table.from_batches([b.select(b.schema.names[2:]) for b in rest]).combine_chunks()
            with pa.ipc.new_stream(sink := pa.BufferOutputStream(), others.schema) as out:
                out.write_table(others)
            return pa.RecordBatch.from_arrays(
                [pa.array([key], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[-1 if t is None else len(t) for t in texts]], pa.list_(pa.int32())),
                 pa.array([raw], pa.int64()), pa.array([pack.compress(b"".join(t for t in texts if t))], pa.binary()),
                 pa.array([sink.getvalue().to_pybytes() if others.num_columns else None], pa.binary())], names=["key", "ids", "lens", "raw", "blob", "rest"])

        for given in batches:
            begin = 0
            for k, (i, t) in enumerate(zip(given.column(0).to_pylist(), given.column(1).to_pylist(), strict=True)):
                if ids and raw + len(t or b"") > CHUNK:
                    rest.append(given.slice(begin, k - begin))
                    yield chunk()
                    key, ids, texts, raw, rest, begin = key + 1, [], [], 0, [], k
                ids.append(i)
                texts.append(t)
                raw += len(t or b"")
            rest.append(given.slice(begin))
        if ids:
            yield chunk()

    others = [F.col(c).alias(f"rest_{k}") for k, c in enumerate(keep)]
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), *others)
    made = plain.mapInArrow(make, "key long, ids array<long>, lens array<int>, raw long, blob binary, rest binary")
    return bucketed(made, path, "key", min(BUCKETS, max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-raw // BUCKET))))


def texts_of(lens: list[int], blob: bytes) -> list[bytes | None]:
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(blob) if blob else b"", 0, []
    for n in lens:
        out.append(None if n < 0 else raw[at : at + n])
        at += max(n, 0)
    return out


def range_bits(raw: int) -> int:
    """Leading bits of a hash that name its range, for so many bytes of text."""
    return max(1, min(MANY_RANGES, (raw // SMALL_RANGE).bit_length()), (raw // RANGE).bit_length())


def cut(first: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(range, begin, end) of the occupied ranges of sorted hashes."""
    r = (first >> np.uint64(64 - bits)).astype(np.int64)
    at = np.flatnonzero(np.r_[True, r[1:] != r[:-1]][: len(r)])
    return list(zip(r[at].tolist(), at.tolist(), np.r_[at[1:], len(r)].astype(int).tolist()))


def digest_run(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct digests, how often each occurs, and the place of each given one among them."""
    order = np.lexsort((values[:, 1], values[:, 0]))
    run = values[order]
    new = np.r_[True, (run[1:] != run[:-1]).any(axis=1)][: len(run)]
    place = np.empty(len(run), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return run[new], np.diff(np.r_[np.flatnonzero(new), len(order)]), place


RUN = "key long, range int, values binary, many binary"
RUN_ARROW = pa.schema([("key", pa.int64()), ("range", pa.int32()), ("values", pa.binary()), ("many", pa.binary())])
BITS_ARROW = pa.schema([("key", pa.int64()), ("range", pa.int32()), ("n", pa.int32()), ("bits", pa.binary())])
#: A run of the log: of a range (of so many bits), sorted anchors and the chunk of each, two entries a chunk at most.
LOGGED = "bits int, range long, values binary, keys binary"
LOGGED_ARROW = pa.schema([("bits", pa.int32()), ("range", pa.int64()), ("values", pa.binary()), ("keys", pa.binary())])


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}


def filled(kind: pa.Schema, columns: dict) -> pa.RecordBatch:
    cells = (columns[f.name] for f in kind)
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cells, kind, strict=True)], schema=kind)


def over_chunks(df: DataFrame, work: Callable[..., tuple[pa.Schema, dict]], schema: str | T.StructType, window: int) -> DataFrame:
    """work(row, Words, texts) for each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            texts = texts_of(row["lens"], row["blob"])
            yield filled(*work(row, Words(texts, window), texts))

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All (anchor, chunk) of rows of LOGGED, sorted."""
    values, keys = (np.concatenate([np.frombuffer(v, dtype=t) for v in table[c].to_pylist()]) for c, t in (("values", np.uint64), ("keys", np.int64)))
    order = np.lexsort((keys, values))
    return values[order], keys[order]


def finer(runs: DataFrame, bits: int) -> DataFrame:
    """Rows of LOGGED with ranges of ``bits`` bits, whatever their own run's were; ranges nest, so rows are cut or renamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            values = np.frombuffer(row["values"], dtype=np.uint64)
            parts = cut(values, bits)
            yield filled(LOGGED_ARROW, {"bits": [bits] * len(parts), "range": [r for r, *_ in parts], "values": [row["values"][8 * a : 8 * b] for _, a, b in parts], "keys": [row["keys"][8 * a : 8 * b] for _, a, b in parts]})

    return runs.where(F.col("bits") == bits).union(runs.where(F.col("bits") != bits).mapInArrow(run, LOGGED))


def one_run(runs: DataFrame) -> DataFrame:
    """The rows of LOGGED, merged to one sorted row a range."""

    def merge(table: pa.Table) -> pa.Table:
        values, keys = entries(table)
        return pa.Table.from_batches([filled(LOGGED_ARROW, {"bits": [table["bits"][0].as_py()], "range": [table["range"][0].as_py()], "values": [values.tobytes()], "keys": [keys.tobytes()]})])

    return runs.groupBy("range").applyInArrow(merge, LOGGED)


def repeated_anchors(runs: DataFrame, batches: list[int]) -> DataFrame:
    """(key, anchors): for each chunk its anchors that start more than once in the runs, and in one of the batches at least."""
    own = np.array(sorted(batches), dtype=np.int64)

    def find(table: pa.Table) -> pa.Table:
        values, keys = entries(table)
        group = np.cumsum(np.r_[True, values[1:] != values[:-1]][: len(values)]) - 1
        ask = (np.bincount(group) > 1) & (np.bincount(group, np.isin(keys >> 48, own)) > 0)
        keep = ask[group] if len(group) else np.zeros(0, bool)
        values, keys = values[keep], keys[keep]
        order = np.lexsort((values, keys))
        values, keys = values[order], keys[order]
        at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
        return pa.table({"key": pa.array(keys[at], pa.int64()), "anchors": pa.array([v.tobytes() for v in np.split(values, at[1:])] if len(at) else [], pa.binary())})

    return runs.groupBy("range").applyInArrow(find, "key long, anchors binary").groupBy("key").agg(F.collect_list("anchors").alias("anchors"))


def merged(runs: DataFrame) -> DataFrame:
    """(key, bits: array<struct<range, n, bits>>): which of the digests of each run are in another run too, or twice in theirs."""

    def merge(table: pa.Table) -> pa.Table:
        keys, many = table["key"].to_pylist(), table["many"].to_pylist()
        values = [np.frombuffer(v, dtype=np.uint64).reshape(-1, 2) for v in table["values"].to_pylist()]
        size = [len(v) for v in values]
        all_ = np.concatenate(values)
        order = np.lexsort(all_.T[::-1])
        s = all_[order]
        same = (s[1:] == s[:-1]).all(axis=1)
        twice = np.empty(len(s), dtype=bool)
        twice[order] = np.r_[False, same] | np.r_[same, False]
        out, at = [], 0
        for key, n, m in zip(keys, size, many, strict=True):
            got = twice[at : at + n] | np.unpackbits(np.frombuffer(m, dtype=np.uint8), count=n).astype(bool)
            out.append((key, table["range"][0].as_py(), n, np.packbits(got).tobytes()))
            at += n
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), BITS_ARROW.types)], schema=BITS_ARROW)

    bits = runs.groupBy("range").applyInArrow(merge, "key long, range int, n int, bits binary")
    return bits.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("range", "n", "bits"))).alias("bits"))


class LogConflict(RuntimeError):
    """Another writer was first."""


class WindowLog:
    """Chunks and anchor runs of all batches so far, below a path that the cluster shares.

    What the log holds is what its newest manifest names: a file that is written elsewhere and then renamed, which fails
    if another writer took the same number (the commit is tried again on top of that writer's). Chunks and runs are never
    changed and have names of their own, so a job that dies at any point leaves the log as it was. A batch has an id, and
    adding it again does nothing; a batch never counts as history of its own, so a caller that fails after it was added
    can judge it again. ``vacuum`` deletes what no manifest names any more.
    """

    def __init__(self, spark: SparkSession, path: str, window: int = 35, fan: int = 4) -> None:
        self.spark, self.path, self.window, self.fan = spark, path.rstrip("/"), window, fan

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        folder, fs = self._path("manifests"), self._fs()
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()) if fs.exists(folder) else []

    def state(self) -> dict:
        """batches: id -> number, raw (bytes of text), chunks (path), count (of chunks); runs: paths."""
        versions = self._versions()
        if not versions:
            return {"version": 0, "window": self.window, "batches": {}, "runs": []}
        stream = self._fs().open(self._path(f"manifests/{versions[-1]}"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(text)
        if found["window"] != self.window:
            raise ValueError(f"the log has windows of {found['window']} words")
        return found | {"version": versions[-1]}

    def _commit(self, state: dict) -> None:
        """Make ``state`` the version after the one that it was made from, or raise LogConflict."""
        jvm, fs = self.spark.sparkContext._jvm, self._fs()
        draft, final = self._path(f"drafts/{uuid.uuid4().hex}"), self._path(f"manifests/{state['version'] + 1}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        fs.mkdirs(final.getParent())
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, final, options)
        except Exception as e:
            if fs.exists(final):
                raise LogConflict(str(final)) from e
            raise

    def _update(self, change: Callable[[dict], dict | None], tries: int = 20) -> None:
        for _ in range(tries):
            new = change(self.state())
            if new is None:
                return
            try:
                return self._commit(new)
            except LogConflict:
                continue
        raise LogConflict(f"{self.path} was changed {tries} times in a row")

    def _reserve(self, batch: str) -> int:
        """A number of its own for the batch, by a commit."""
        taken = []

        def change(state: dict) -> dict:
            taken[:] = [state.get("numbers", 0) + 1]
            return state | {"numbers": taken[0]}

        self._update(change)
        return taken[0]

    def _runs(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(LOGGED).parquet(*names)

    def _write(self, runs: DataFrame) -> str:
        name = f"{self.path}/run-{uuid.uuid4().hex}"
        one_run(runs).write.option("compression", "zstd").parquet(name)
        return name

    def add(self, docs: DataFrame, batch: str, keep: Sequence[str] = ()) -> DataFrame | None:
        """Add a batch (its chunks, bucketed, are returned); None if the log has it already. ``keep``: columns that its result will carry."""
        if batch in self.state()["batches"]:
            return None
        ship(self.spark)
        small_batches(self.spark)
        raw = int(docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0)
        number = self._reserve(batch)
        path = f"{self.path}/chunks-{uuid.uuid4().hex}"
        packed = chunks(docs, keep, number, raw, path)
        count = packed.count()
        bits = range_bits(raw)

        def anchor_rows(row: dict, words: Words, texts: list) -> tuple[pa.Schema, dict]:
            value, n = np.unique(words.anchors(), return_counts=True)
            value = np.repeat(value, np.minimum(n, 2))
            parts = cut(value, bits)
            return LOGGED_ARROW, {"bits": [bits] * len(parts), "range": [r for r, *_ in parts], "values": [value[a:b].tobytes() for _, a, b in parts], "keys": [np.full(b - a, row["key"], np.int64).tobytes() for _, a, b in parts]}

        run = self._write(over_chunks(packed.select("key", "lens", "blob"), anchor_rows, LOGGED, self.window))

        def change(state: dict) -> dict | None:
            if batch in state["batches"]:
                return None
            return state | {"batches": state["batches"] | {batch: {"number": number, "raw": raw, "chunks": path, "count": count}}, "runs": [*state["runs"], run]}

        self._update(change)
        self.compact()
        return packed

    def compact(self) -> None:
        """Merge the runs to one if there are more than ``fan``."""
        names = self.state()["runs"]
        if len(names) > self.fan:
            bits = max(self._runs(names).agg(F.max("bits")).first()[0] or 1, range_bits(sum(b["raw"] for b in self.state()["batches"].values())))
            run = self._write(finer(self._runs(names), bits))

            def change(state: dict) -> dict | None:
                return state | {"runs": [r for r in state["runs"] if r not in names] + [run]} if set(names) <= set(state["runs"]) else None

            self._update(change)

    def vacuum(self) -> None:
        """Delete runs, chunks, drafts and manifests that the newest manifest does not need. No other job may be using the log."""
        state, fs = self.state(), self._fs()
        used = {*state["runs"], *(b["chunks"] for b in state["batches"].values())}
        for s in fs.listStatus(self._path("manifests").getParent()):
            name = s.getPath().getName()
            if name.startswith(("run-", "chunks-")) and f"{self.path}/{name}" not in used:
                fs.delete(s.getPath(), True)
        fs.delete(self._path("drafts"), True)
        for v in self._versions()[:-1]:
            fs.delete(self._path(f"manifests/{v}"), False)

    def judged(self, batches: dict[str, DataFrame | None], digest: bool = False, others: T.StructType | None = None) -> DataFrame:
        """``remove_repeats``'s rows of the batches (with their chunks where they are at hand), judged against all the log holds now."""
        state, window = self.state(), self.window
        known = state["batches"]
        own = {known[b]["number"]: df for b, df in batches.items()}
        raw = sum(b["raw"] for b in known.values())
        bits = range_bits(raw)
        most = max(self._runs(state["runs"]).agg(F.max("bits")).first()[0] or 1, bits)
        anchors = stored(repeated_anchors(finer(self._runs(state["runs"]), most), list(own)), "repeated-anchors")

        def tables(names: Sequence[str]) -> list[DataFrame]:
            """Chunks of the batches to judge, one table each: bucketed, if they were packed in this run."""
            out = []
            for b, entry in known.items():
                if entry["count"] and (entry["number"] in own) and b in names:
                    out.append(own[entry["number"]] if own[entry["number"]] is not None else self.spark.read.parquet(entry["chunks"]))
            return out

        def history() -> list[DataFrame]:
            """Chunks of other batches that hold a repeated anchor; their keys, 8 bytes a chunk, are broadcast up to 64 MB."""
            rest = [b for b in known.values() if b["number"] not in own and b["count"]]
            if not rest:
                return []
            keys = anchors.select("key")
            keys = F.broadcast(keys) if sum(b["count"] for b in known.values()) <= 8_000_000 else keys
            return [self.spark.read.parquet(*(b["chunks"] for b in rest)).join(keys, "key", "left_semi")]

        def candidates(row: dict, words: Words) -> np.ndarray:
            mine = words.anchors()
            got = np.sort(np.frombuffer(b"".join(row["anchors"] or ()), dtype=np.uint64))
            at = np.minimum(np.searchsorted(got, mine), max(len(got) - 1, 0))
            return words.windows(got[at] == mine if len(got) else np.zeros(len(mine), bool))

        def window_runs(row: dict, words: Words, texts: list) -> tuple[pa.Schema, dict]:
            run, n, _ = digest_run(words.digests(candidates(row, words)))
            parts = cut(run[:, 0], bits)
            return RUN_ARROW, {"key": [row["key"]] * len(parts), "range": [r for r, *_ in parts], "values": [run[a:b].tobytes() for _, a, b in parts], "many": [np.packbits(n[a:b] > 1).tobytes() for _, a, b in parts]}

        def kept(row: dict, words: Words, texts: list) -> tuple[pa.Schema, dict]:
            gone = np.zeros(len(words.h), dtype=bool)
            if row["bits"]:
                at = candidates(row, words)
                place = digest_run(words.digests(at))[2]
                twice = np.concatenate([np.unpackbits(np.frombuffer(b["bits"], dtype=np.uint8), count=b["n"]) for b in row["bits"]]).astype(bool)
                gone = words.covered(at[twice[place]])
            end = np.cumsum(words.counts)
            lost = np.r_[0, np.cumsum(gone)]
            lost = lost[end] - lost[end - words.counts]
            out = []
            for t, a, b, k in zip(texts, end - words.counts, end, lost, strict=True):
                if digest:
                    w = t.split() if t else []
                    out.append(hashlib.sha256(b" ".join([x for x, g in zip(w, gone[a:b].tolist(), strict=True) if not g] if k else w)).hexdigest())
                else:
                    out.append(None if t is None else b" ".join([x for x, g in zip(t.split(), gone[a:b].tolist(), strict=True) if not g]) if k else t)
            columns = {"doc_id": row["ids"], "n_words": words.counts, "n_removed": lost}
            if digest:
                kind, columns["kept_sha256"] = DIGEST_ARROW, out
            else:
                kind, columns["text"] = KEPT_ARROW, [None if t is None else t.decode("utf-8", "replace") for t in out]
            if row["rest"] is not None:
                with pa.ipc.open_stream(row["rest"]) as given:
                    rest = given.read_all().combine_chunks()
                kind = pa.schema([*kind, *rest.schema])
                columns |= {c: pa.concat_arrays(rest.column(c).chunks) for c in rest.schema.names}
            return kind, columns

        mine = tables(list(batches))
        schema = T.StructType([*T.StructType.fromDDL(DIGEST if digest else KEPT), *(others or [])])
        if not mine:
            return self.spark.createDataFrame([], schema)
        met = [t.select("key", "lens", "blob").join(anchors, "key") for t in (*mine, *history())]
        runs = [over_chunks(t, window_runs, RUN, window) for t in met]
        found = stored(merged(together(runs)), "repeated-windows")
        out = [over_chunks(t.join(anchors, "key", "left").join(found, "key", "left"), kept, schema, window) for t in mine]
        return together(out)


def together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"
DIGEST_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
KEPT = "doc_id long, n_words long, n_removed long, text string"
KEPT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])


def remove_repeats(docs: DataFrame, window: int = 35, log: WindowLog | None = None, batch: str | None = None, digest: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Per document (doc_id, n_words, n_removed, text): without the words covered by a window that starts anywhere else.

    Words are runs of bytes other than ASCII white space. A window is ``window`` consecutive words of one document; all
    its copies go, in the same document too. The text of a document that loses nothing is unchanged; of the others, the
    kept words are joined by one space. A null text stays null (no words); rows with null or repeated doc_ids are
    documents like any other; an empty table gives no rows. The columns named in ``keep`` follow unchanged, as rest_0,
    rest_1 and so on. With ``digest``, kept_sha256 (of the kept words joined by one space) replaces text.

    With ``log``, the documents are its batch ``batch`` (added, if it is not there yet) and windows of its other batches
    count as well. Without, the table goes through a log of its own in BATCHES batches (by a hash of id and text), and all
    of them are judged when the last one is in.
    """
    spark = docs.sparkSession
    others = T.StructType([T.StructField(f"rest_{k}", docs.schema[c].dataType) for k, c in enumerate(keep)])
    if log is not None:
        if batch is None:
            raise ValueError("a batch of a log needs an id")
        if log.window != window:
            raise ValueError(f"the log has windows of {log.window} words")
        return log.judged({batch: log.add(docs, batch, keep)}, digest, others)
    log = WindowLog(spark, shared_path(spark, "window-log"), window)
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string")), F.lit(BATCHES))
    return log.judged({str(k): log.add(docs.where(part == k), str(k), keep) for k in range(BATCHES)}, digest, others)


def without_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """The documents, with all their columns (doc_id as a long), their texts as ``remove_repeats`` leaves them."""
    keep = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = remove_repeats(docs, window, keep=keep)
    at = {c: f"rest_{k}" for k, c in enumerate(keep)} | {"doc_id": "doc_id", "text": "text"}
    return out.select(*(F.col(at[c]).alias(c) for c in docs.columns))


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, through a log of two batches."""
    from .common import documents

    return remove_repeats(documents(spark, sf_dir, "doc_id", "text"), digest=True)


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
h AS (SELECT r, i, word, CASE WHEN i <= n - 34 THEN md5(string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) END AS h FROM p),
m AS (SELECT r, i, word, h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 AS twice FROM h),
g AS (SELECT r, i, word, max(twice::INTEGER) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) = 1 AS gone FROM m),
k AS (SELECT r, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY 1)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
