"""Benchmark decontamination: Wu-Manber search for benchmark word windows in documents.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the ASCII-lower-cased UTF-8 text. The
patterns are all windows of `window` consecutive words of each item (the whole item where
it is shorter). The text is searched over words, not bytes: a table of shifts by pairs of
words jumps over places where no pattern can end, a bucket of the patterns that end with
the pair is tried where the shift is zero, and words are compared directly. Patterns of
one length form one table, so a short item does not shorten the jumps of the others.

Documents are only mapped, never shuffled. The patterns come in blocks of items of about
`BLOCK_BYTES` of text; each block is broadcast and searched in all documents, and the hits
found so far travel with the row, so a large benchmark takes more passes, not more memory.

Defined results: a null or empty text has no words and is clean; an item without words or
without `item_id` is left out; repeated items count once by `item_id`; repeated documents
are judged row by row; other columns are ignored; empty tables give clean or no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.common import give_back, id_and_text, sha256_hex, ship
from tideglass.session import materialise

WINDOW = 13
BLOCK_BYTES = 8 << 20
#: A document is contaminated if at least one word in so many is hit.
ONE_IN = 20

#: Letters to lower case, bytes outside words to a space.
_TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)

_FOUND = pa.struct(
    [
        ("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.int64())),
        ("n_hit", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()),
    ]
)
_FOUND_TYPE = (
    "struct<n_words: bigint, spans: array<bigint>, items: array<bigint>, n_hit: bigint,"
    " items_sha256: string, contaminated: boolean>"
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


class PatternTable:
    """Shift and bucket tables of patterns that are all `length` words long."""

    def __init__(self, length: int, patterns: dict[tuple, set[int]]) -> None:
        self.length = length
        self.block = min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, list[tuple[tuple, tuple[int, ...]]]] = {}
        for words, items in patterns.items():
            for end in range(self.block, length + 1):
                key = words[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.far), length - end)
            self.buckets.setdefault(words[length - self.block :], []).append((words, tuple(sorted(items))))

    def search(self, words: list[bytes]):
        """Yield start and items of every occurrence, by start."""
        length, block, far, shift, buckets = self.length, self.block, self.far, self.shift, self.buckets
        end, n = length, len(words)
        while end <= n:
            key = tuple(words[end - block : end])
            jump = shift.get(key, far)
            if jump:
                end += jump
                continue
            first = words[end - length]
            for pattern, items in buckets[key]:
                if pattern[0] == first and pattern == tuple(words[end - length : end]):
                    yield end - length, items
                    break  # patterns of a table are distinct
            end += 1


def compile_items(items: list[tuple[int, bytes]], window: int) -> list[PatternTable]:
    by_length: dict[int, dict[tuple, set[int]]] = {}
    for item_id, text in items:
        words = words_of(text)
        length = min(window, len(words))
        if length:
            patterns = by_length.setdefault(length, {})
            for start in range(len(words) - length + 1):
                patterns.setdefault(tuple(words[start : start + length]), set()).add(item_id)
    return [PatternTable(length, patterns) for length, patterns in sorted(by_length.items())]


def _item_blocks(items: DataFrame, key: str, block_bytes: int):
    """Items in blocks whose text fits the bound on average; each is read on its own."""
    kept = items.select(
        F.col(key).cast("long").alias("item_id"), F.col("text").cast("string").alias("text")
    ).where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    size = kept.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, math.ceil(size / block_bytes))
    for number in range(count):
        block = kept
        if count > 1:
            block = kept.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == number)
        yield count, [(row.item_id, row.text.encode()) for row in block.collect()]


def _verdict(n_words: int, spans: list[int], items: set[int]) -> dict:
    """Words hit, digest of the items, and whether that is too much."""
    hit = np.zeros(n_words if spans else 0, dtype=bool)
    for a, b in zip(spans[::2], spans[1::2]):
        hit[a:b] = True
    n_hit = int(hit.sum())
    return {
        "n_hit": n_hit,
        "items_sha256": sha256_hex(",".join(sorted(map(str, items))).encode()),
        "contaminated": n_hit > 0 and ONE_IN * n_hit >= n_words,
    }


def _finder(tables: Broadcast):
    """The search for one block of patterns, added to what earlier blocks found."""

    def find(texts: pa.Array, before: pa.Array) -> pa.Array:
        found = []
        for text, known in zip(texts, before.to_pylist(), strict=True):
            words = words_of(text.as_buffer().to_pybytes()) if text.is_valid else []
            spans = known["spans"] if known else []
            items = set(known["items"]) if known else set()
            for one in tables.value:
                for start, ids in one.search(words):
                    if spans and spans[-2] <= start <= spans[-1]:
                        spans[-1] = max(spans[-1], start + one.length)
                    else:
                        spans += (start, start + one.length)
                    items.update(ids)
            found.append({"n_words": len(words), "spans": spans, "items": sorted(items)} | _verdict(len(words), spans, items))
        give_back()
        return pa.array(found, type=_FOUND)

    return F.arrow_udf(find, _FOUND_TYPE)


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with `_found`: number of words, ranges of words hit, ids of the items found, verdict."""
    spark = ship(docs.sparkSession)
    state, done = docs.withColumn("_found", F.lit(None).cast(_FOUND_TYPE)), 0
    for count, block in _item_blocks(benchmark, "item_id", block_bytes):
        find = _finder(spark.sparkContext.broadcast(compile_items(block, window)))
        state = state.withColumn("_found", find(F.col("text"), F.col("_found")))
        done += 1
        if done < count:
            state = materialise(state)
    return state


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: words, words hit, items found, and whether it is contaminated."""
    return search(id_and_text(docs), benchmark, window, block_bytes).select(
        "doc_id",
        "_found.n_words",
        "_found.n_hit",
        F.size("_found.items").cast("long").alias("n_items"),
        "_found.items_sha256",
        "_found.contaminated",
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    return search(docs, benchmark).where(~F.col("_found.contaminated")).select(*[F.col(f"`{c}`") for c in docs.columns])
