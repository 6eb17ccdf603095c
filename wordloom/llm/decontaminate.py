"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

A test item is the set of its word shingles. A document contains it when it has at least
`percent` of a hundred of them. Items are dealt into size ranges. Each range keeps a bottom-k
MinHash sketch of every item, with k one more than the shingles that the range's largest item
may miss: a document that contains the item therefore has at least k less the item's own misses
of the sketch. A document probes the ranges whose items it is large enough to contain; items
with enough sketch hits are then compared by all their shingles. An item of fewer words than a shingle
is one shingle of its own length, and is looked for among the documents' shingles of that length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U64, chunks, shingle_sets, shingles, words

BLOCK_BYTES = 4 << 20  # of item text that one pass over the documents takes along
SIZE_RATIO = 1.5
_SIEVE = U64((1 << 20) - 1)


class SizeRange:
    """Sketches of the items whose number of shingles is in [low, high)."""

    def __init__(self, items: list[int], sets: list[np.ndarray], low: int, high: int, percent: int):
        self.low, self.percent = low, percent
        k = (high - 1) * (100 - percent) // 100 + 1
        hashes = [sets[i][:k] for i in items]
        size = [len(x) for x in hashes]
        self.hash = np.concatenate(hashes)
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.item = self.hash[order], np.repeat(items, size)[order]
        self.sieve = np.zeros(int(_SIEVE) + 1, bool)
        self.sieve[(self.hash & _SIEVE).astype(np.int64)] = True
        self.needs = {i: len(x) - len(sets[i]) * (100 - percent) // 100 for i, x in zip(items, hashes)}

    def candidates(self, x: np.ndarray, text: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
        """(text, item) pairs with enough sketch hits. x: shingle hashes of the texts numbered in text."""
        on = self.sieve[(x & _SIEVE).astype(np.int64)] & (100 * size[text] >= self.percent * self.low)
        x, text = x[on], text[on]
        left, right = np.searchsorted(self.hash, x), np.searchsorted(self.hash, x, side="right")
        hit = right > left
        if not hit.any():
            return []
        left, times = left[hit], (right - left)[hit]
        at = np.repeat(left - np.append(0, np.cumsum(times)[:-1]), times) + np.arange(times.sum())
        found = np.unique(np.stack([np.repeat(text[hit], times), self.item[at], np.repeat(left, times)], 1), axis=0)
        pairs, hits = np.unique(found[:, :2], axis=0, return_counts=True)
        return [(int(t), int(i)) for (t, i), n in zip(pairs, hits) if n >= self.needs[int(i)]]


def size_partitioned(sets: list[np.ndarray], percent: int, of: list[int] | None = None) -> list[SizeRange]:
    """Ranges of all sets, or of those numbered in of."""
    of = np.arange(len(sets)) if of is None else np.array(of, np.int64)
    size = np.array([len(sets[i]) for i in of], np.int64)
    ranges, low = [], 1
    while low <= size.max(initial=0):
        high = max(low + 1, int(low * SIZE_RATIO))
        own = of[(size >= low) & (size < high)].tolist()
        if own:
            ranges.append(SizeRange(own, sets, low, high, percent))
        low = high
    return ranges


class Items:
    """Distinct item texts, the set of each one's shingles, and their size ranges by the length of these shingles."""

    def __init__(self, texts: list[str], shingle: int, percent: int):
        self.percent, self.texts, self.sets, length = percent, [], [], []
        for t in texts:
            n = len(words(*_one(t))[0])
            if n:
                length.append(min(n, shingle))
                self.texts.append(t)
                self.sets += shingle_sets(pa.array([t], pa.string()), length[-1])
        self.ranges = {k: size_partitioned(self.sets, percent, [i for i, n in enumerate(length) if n == k]) for k in sorted(set(length))}

    def hits(self, texts: pa.Array) -> Iterator[tuple[int, int, int]]:
        """(row, item, shingles in common) of each item that a text contains."""
        for at, end, data, offsets in chunks(texts):
            h, first = words(data, offsets)
            for k, ranges in self.ranges.items():
                x, text = shingles(h, first, k)
                size = np.bincount(text, minlength=end - at)
                cut = np.append(0, np.cumsum(size))
                for r in ranges:
                    for t, i in r.candidates(x, text, size):
                        both = int(np.isin(self.sets[i], x[cut[t] : cut[t + 1]]).sum())
                        if 100 * both >= self.percent * len(self.sets[i]):
                            yield at + t, i, both


def _one(text: str) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text.encode(), np.uint8)
    return data, np.array([0, len(data)])


def _search(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits = list(items.hits(batch.column(1)))
        if hits:
            row, item, common = zip(*hits)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(item, pa.int32()), pa.array(common, pa.int32())], names=["id", "item", "common"])


def _clean(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stays = np.ones(len(batch), bool)
        stays[[row for row, _, _ in items.hits(batch.column("text"))]] = False
        yield batch.filter(pa.array(stays))


def _item_blocks(items: DataFrame) -> Iterator[list[str]]:
    """The distinct texts of items (text) in blocks of about BLOCK_BYTES of text; a text is in one of them, however often it is given."""
    texts = items.select("text").where("text is not null").distinct()
    blocks = max(1, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    for block in range(blocks):
        yield [r.text for r in texts.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()]  # BLOCK_BYTES of text or near it


def contained_items(docs: DataFrame, items: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_item, n_common): each row of docs (doc_id, text) with each item (item_id, text) it contains.

    n_item counts the item's distinct shingles, n_common those in the document. Other columns
    are ignored. Distinct item texts go along in blocks of BLOCK_BYTES; each block is one pass
    over the documents. An item with fewer words than a shingle is one shingle and is in every document in which its
    words follow each other. Null or wordless texts contain
    nothing and are in nothing. Rows given twice come out twice; null ids stay null. doc_id must be an integer. Without
    documents or items there are no rows.
    """
    out = None
    for texts in _item_blocks(items):
        own = Items(texts, shingle, percent)
        if not own.texts:
            continue
        found = docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(lambda it, own=own: _search(it, own), "id long, item int, common int")
        named = docs.sparkSession.createDataFrame([(k, len(s), t) for k, (t, s) in enumerate(zip(own.texts, own.sets))], "item int, n_item long, of string")
        found = found.join(F.broadcast(named), "item").select("id", "n_item", F.col("common").cast("long").alias("n_common"), "of")  # one block of items
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.select("doc_id").join(items.select("item_id"), F.lit(False)).selectExpr("doc_id", "item_id", "0L n_item", "0L n_common")
    return out.join(items.select("item_id", "text"), F.col("of") == F.col("text")).select(F.col("id").alias("doc_id"), "item_id", "n_item", "n_common")


def decontaminated(docs: DataFrame, items: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs, all its columns, without the rows whose text contains an item; see contained_items. A null text stays."""
    for texts in _item_blocks(items):
        own = Items(texts, shingle, percent)
        docs = docs.mapInArrow(lambda it, own=own: _clean(it, own), docs.schema) if own.texts else docs
    return docs
