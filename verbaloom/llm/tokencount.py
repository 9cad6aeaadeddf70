"""Token counts that follow edits.

A document keeps a segment tree over its pre-tokens, with the characters and tokens below each node. An edit finds its
pre-tokens by descending on characters, widens to white space on both sides (nothing merges across white space),
re-encodes that region alone, and updates the sums above the slots it touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, ship, small_batches, text_groups
from .tokens import WordBpe, word_bpe

SPACE = "\t\n\v\f\r "


def tree(leaves: np.ndarray) -> np.ndarray:
    """Sums, the root at 1 and the leaves from the middle on."""
    n = 1 << max(0, len(leaves) - 1).bit_length()
    out = np.zeros(2 * n, dtype=np.int64)
    out[n : n + len(leaves)] = leaves
    while n > 1:
        half = n // 2
        out[half:n] = out[n : 2 * n].reshape(-1, 2).sum(axis=1)
        n = half
    return out


class TokenTree:
    """Segment tree over the pre-tokens of one text; ``sizes`` and ``tokens`` are those of its slots."""

    def __init__(self, bpe: WordBpe, text: str, sizes: list[int], tokens: list[int]) -> None:
        self.bpe, self.text = bpe, text
        rest = len(text) - sum(sizes)
        sizes = np.array([*sizes, rest], dtype=np.int64)
        self.begin = np.cumsum(sizes) - sizes
        self.changed: dict[int, str] = {}
        self.chars, self.tokens = tree(sizes), tree(np.array([*tokens, 0], dtype=np.int64))
        self.n = len(sizes)
        self.leaf = len(self.chars) // 2

    @classmethod
    def of(cls, bpe: WordBpe, text: str) -> TokenTree:
        keys, sizes = bpe.slots(text)
        known = bpe.learn([keys])
        return cls(bpe, text, sizes, [len(known[k]) // 4 for k in keys])

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    @property
    def n_chars(self) -> int:
        return int(self.chars[1])

    def slot(self, i: int) -> str:
        return self.changed[i] if i in self.changed else self.text[self.begin[i] : self.begin[i] + self.chars[self.leaf + i]]

    def find(self, at: int) -> tuple[int, int]:
        """The slot that holds the character ``at`` (the last slot, for the end), and the characters before that slot."""
        if at >= self.chars[1]:
            return self.n - 1, int(self.chars[1] - self.chars[self.leaf + self.n - 1])
        node, before = 1, 0
        while node < self.leaf:
            node *= 2
            if at - before >= self.chars[node]:
                before += int(self.chars[node])
                node += 1
        return node - self.leaf, before

    def _set(self, i: int, text: str, tokens: int) -> None:
        self.changed[i] = text
        node = self.leaf + i
        more, plus = len(text) - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += more
            self.tokens[node] += plus
            node //= 2

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace the characters from start to end (cut to the text); gives the characters that were encoded again."""
        start = min(max(0, start), self.n_chars)
        end = min(max(start, end), self.n_chars)
        i, first = self.find(start)
        j = max(i, self.find(end - 1)[0]) if end > start else i
        # to the left: a slot that begins with white space which the edit does not touch
        while i and not (self.slot(i)[:1] in SPACE and self.slot(i) and first < start):
            i -= 1
            first -= int(self.chars[self.leaf + i])
        # to the right: up to a slot that begins with white space
        while j + 1 < self.n and not (self.slot(j + 1) and self.slot(j + 1)[0] in SPACE):
            j += 1
        old = "".join(self.slot(k) for k in range(i, j + 1))
        region = old[: start - first] + new + old[end - first :]
        self._set(i, region, len(self.bpe.encode([region])[0]) // 4)
        for k in range(i + 1, j + 1):
            if self.chars[self.leaf + k] or self.tokens[self.leaf + k]:
                self._set(k, "", 0)
        return len(region)


COUNTS = "doc_id long, n_tokens long, n_edits int, n_tokens_after long, n_chars_after long, n_reencoded long"


def count_with_edits(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per document (doc_id, text, edits: array<struct<start, end, text>>): its tokens before and after its edits.

    Edits apply in order; their positions are characters of the text as it then is, cut to its length, and a null text
    or position of an edit is empty or 0. A null document text is empty; null edits are none. n_reencoded counts the
    characters of the regions that were encoded again: a text without white space is one region, so any edit of it encodes all of it again. Other columns are ignored; rows with null or repeated doc_ids
    are documents like any other; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        for batch, texts in text_groups(batches):
            slots = [bpe.slots(t or "") for t in texts]
            known = bpe.learn([k for k, _ in slots])
            counts = [[len(known[k]) // 4 for k in keys] for keys, _ in slots]
            rows = []
            for doc, text, (_, sizes), tokens, edits in zip(batch.column(0).to_pylist(), texts, slots, counts, batch.column(2).to_pylist(), strict=True):
                t = TokenTree(bpe, text or "", sizes, tokens)
                before, again = t.n_tokens, 0
                for e in edits or ():
                    if e is not None:
                        again += t.edit(e["start"] or 0, e["end"] or 0, e["text"] or "")
                rows.append((doc, before, len(edits or ()), t.n_tokens, t.n_chars, again))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=[x.split()[0] for x in COUNTS.split(", ")])

    edits = F.col("edits").cast("array<struct<start: long, end: long, text: string>>")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), edits.alias("edits")).mapInArrow(run, COUNTS)


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """Every document, with a passage cut at its end, one put in at two thirds, and one replaced at a third."""
    import public_tokenizers

    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    edit = lambda a, b, t: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"), F.lit(t).alias("text"))
    third = F.floor(n / 3)
    edits = F.array(edit(F.greatest(n - 15, F.lit(0)), n, ""), edit(F.floor(2 * n / 3), F.floor(2 * n / 3), " (see the note) "), edit(third, third + 20, "revised Passage, 2nd ed"))
    return count_with_edits(documents(spark, sf_dir, "doc_id", "text").withColumn("edits", edits), public_tokenizers.path("word_bpe_49k.json"))
