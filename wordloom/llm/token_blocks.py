"""Counts of words and of (context, word) pairs over shards of words, and replies to blocks of text.

Texts are packed into blocks of about BLOCK_BYTES. A block asks the shards for what it needs to know of the whole corpus: a request
lists the block's distinct words of one shard and, for each, the contexts it stands in; the reply has one value for each, in the
same order. So a pair is one entry a block, however frequent it is. A shard holds all pairs of its words, and a word has CONTEXTS
pairs at most, so no shard grows with a hot word; the number of shards follows from the bytes of text.

Every word has counts of its own. The context of a word is the word before it: words with a share of MIN_SHARE or more of the
training tokens, and the end of text, are contexts of their own; other words share a context with those of the same hash bucket.
So what is kept for contexts are arrays of CONTEXTS numbers at any size of corpus. Words are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kept, text_bytes
from .words import U64, blocks, chunks, words

BLOCK_BYTES = 16 << 20
SHARD_BYTES = 24 << 20  # of training text for each shard
MIN_SHARE = 2e-5
CONTEXTS = 1 << 18
RANGES = 16  # in which arrays over contexts are summed
FAN = 64  # of these arrays that are summed at once
END = U64(0x0E4D0F7E87)


def squeeze(x: np.ndarray) -> bytes:
    """uint32 values, packed byte by byte: the high bytes of small numbers compress to little."""
    return zstandard.compress(np.asarray(x).astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def unsqueeze(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def squeeze_lists(fan: np.ndarray, x: np.ndarray) -> bytes:
    """Ascending numbers in lists of fan numbers, one or more, as differences."""
    d = np.diff(x, prepend=0)
    first = np.cumsum(fan) - fan
    d[first] = x[first]
    return squeeze(d)


def unsqueeze_lists(fan: np.ndarray, b: bytes) -> np.ndarray:
    fan, d = fan.astype(np.int64), unsqueeze(b).astype(np.int64)
    total, first = np.cumsum(d), np.cumsum(fan) - fan
    return total - np.repeat(total[first] - d[first], fan)


def squeeze_sorted(x: np.ndarray) -> bytes:
    """Sorted 64-bit values as differences, byte by byte."""
    return zstandard.compress(np.diff(x, prepend=U64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), 3)


def unsqueeze_sorted(b: bytes) -> np.ndarray:
    gaps = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(gaps).view(U64).ravel(), dtype=U64)


class Contexts:
    """Context of each word: frequent words have one each, in the order given, the end has one, other words share those left by hash."""

    def __init__(self, frequent: np.ndarray, n: int = 0):
        frequent = frequent[frequent != END]
        self.rank = np.argsort(frequent)
        self.words, self.end, self.n = frequent[self.rank], len(frequent), n or CONTEXTS
        if self.end + 1 >= self.n:
            raise ValueError("more frequent words than contexts")

    def of(self, vocab: np.ndarray) -> np.ndarray:
        out = (self.end + 1 + (vocab & U64(0xFFFFFFFF)) % U64(self.n - self.end - 1)).astype(np.int64)
        if self.end:
            at = np.minimum(np.searchsorted(self.words, vocab), self.end - 1)
            out = np.where(self.words[at] == vocab, self.rank[at], out)
        out[vocab == END] = self.end
        return out


# blocks


def tokens(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all rows, number of words of each row)."""
    hs, ns = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for _, _, data, offsets in chunks(rows.column("text")):
        h, starts = words(data, offsets)
        hs.append(h)
        ns.append(np.diff(starts))
    return np.concatenate(hs), np.concatenate(ns)


def places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(distinct words and the end, in order; place of each word among them; place of the end)."""
    vocab, at = np.unique(np.append(h, END), return_inverse=True)
    return vocab, at[:-1], int(at[-1])


def stream(at: np.ndarray, n: np.ndarray, end: int, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each token, its context, its text), texts' ends included; the end is the context of a text's first token."""
    text = np.repeat(np.arange(len(n)), n + 1)
    place = np.full(len(text), end, np.int64)
    word = np.ones(len(text), bool)
    word[np.cumsum(n + 1) - 1] = False
    place[word] = at
    before = np.append(end, place[:-1]) if len(place) else place
    return place, context[before], text


def coded(place: np.ndarray, before: np.ndarray, n: int) -> np.ndarray:
    return place * n + before


# frequent words


def _shard_of(vocab: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each word: a range of hashes, so that sorted words are in order of shards."""
    return ((vocab >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def _bucket(vocab: np.ndarray) -> np.ndarray:
    return ((vocab >> U64(40)) % U64(CONTEXTS)).astype(np.int64)


def _times(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct words and the end, how often each is there) of each block."""
    for _, rows in blocks(batches, "text", BLOCK_BYTES):
        h, n = tokens(rows)
        vocab, at, end = places(h)
        counts = np.bincount(at, minlength=len(vocab))
        counts[end] += len(n)
        yield vocab, counts


def _bucket_sums(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """A task's tokens by bucket of words."""
    total = np.zeros(CONTEXTS, np.int64)
    for vocab, counts in _times(batches):
        total += np.bincount(_bucket(vocab), counts, CONTEXTS).astype(np.int64)
    if total.any():
        yield ranged(TaskContext.get().partitionId() % shards, by_range(total))


def _words_in(batches: Iterator[pa.RecordBatch], full: np.ndarray) -> Iterator[pa.RecordBatch]:
    for vocab, counts in _times(batches):
        own = full[_bucket(vocab)]
        yield pa.RecordBatch.from_arrays([pa.array(vocab[own].view(np.int64)), pa.array(counts[own], pa.int64())], names=["word", "times"])


def contexts_of(train: DataFrame, shards: int) -> tuple[Contexts, int]:
    """(contexts, training tokens with ends) of the training texts (text).

    Words are counted exactly, so which have contexts of their own doesn't depend on how rows fall into blocks; 1 / MIN_SHARE words at most have the share.
    A word with the share is in a bucket that has it, so buckets of words are counted first, and then the words of these buckets alone.
    """
    sums = train.select("text").mapInArrow(lambda it: _bucket_sums(it, shards), "shard int, range int, sums binary")
    buckets = context_sums(sums, shards - 1, 1, CONTEXTS)[0]
    total = int(buckets.sum())
    least = max(MIN_SHARE * total, 1)
    full = buckets >= least
    counts = train.select("text").mapInArrow(lambda it: _words_in(it, full), "word long, times long").groupBy("word").agg(F.sum("times").alias("times"))
    found = counts.where(F.col("times") >= least).toPandas()
    words_, times = found["word"].to_numpy(np.int64).view(U64), found["times"].to_numpy(np.int64)
    return Contexts(words_[np.lexsort((words_, -times))]), total  # the most frequent first, as small numbers pack well


# pairs


PAIRS = "shard int, block long, words binary, fan binary, context binary, counts binary"


def _pairs_of(number: int, vocab: np.ndarray, code: np.ndarray, counts: np.ndarray | None, n: int, shards: int) -> pa.RecordBatch:
    """A row for each shard. code: distinct pairs in order, place * n + context."""
    place, context = code // n, code % n
    ends = np.searchsorted(_shard_of(vocab, shards), np.arange(shards + 1))
    cuts = np.searchsorted(place, ends)
    full = np.flatnonzero(np.diff(cuts))
    fan = np.bincount(place, minlength=len(vocab))
    rows = [
        (k, number, squeeze_sorted(vocab[ends[k] : ends[k + 1]]), squeeze(fan[ends[k] : ends[k + 1]]), squeeze_lists(fan[ends[k] : ends[k + 1]], context[cuts[k] : cuts[k + 1]]), None if counts is None else squeeze(counts[cuts[k] : cuts[k + 1]]))
        for k in full
    ]
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
    cols = list(zip(*rows)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split(" ")[0] for x in PAIRS.split(", ")])


def _pair_requests(batches: Iterator[pa.RecordBatch], contexts: Contexts, shards: int, counted: bool) -> Iterator[pa.RecordBatch]:
    for number, rows in blocks(batches, "text", BLOCK_BYTES):
        h, n = tokens(rows)
        vocab, at, end = places(h)
        place, before, _ = stream(at, n, end, contexts.of(vocab))
        code, counts = np.unique(coded(place, before, contexts.n), return_counts=True)
        yield _pairs_of(number, vocab, code, counts if counted else None, contexts.n, shards)


def _packed(group: pd.DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words in order, distinct pairs as place * n + context, counts) of a shard's requests."""
    every = [unsqueeze_sorted(x) for x in group["words"]]
    vocab, at = np.unique(np.concatenate(every), return_inverse=True)
    fans = [unsqueeze(x) for x in group["fan"]]
    code = np.repeat(at, np.concatenate(fans)) * n + np.concatenate([unsqueeze_lists(f, x) for f, x in zip(fans, group["context"])])
    code, back = np.unique(code, return_inverse=True)
    return vocab, code, np.bincount(back, np.concatenate([unsqueeze(x) for x in group["counts"]]), len(code)).astype(np.int64)


COUNTS = "shard int, words binary, fan binary, context binary, counts binary"
WORD_SUMS = "types long, k1 long, k2 long, k3 long, k4 long, fans long"


def _shard_counts(group: pd.DataFrame, n: int) -> pd.DataFrame:
    vocab, code, counts = _packed(group, n)
    fan = np.bincount(code // n, minlength=len(vocab))
    row = (int(group["shard"].iloc[0]), squeeze_sorted(vocab), squeeze(fan), squeeze_lists(fan, code % n), squeeze(counts))
    return pd.DataFrame([row], columns=[x.split(" ")[0] for x in COUNTS.split(", ")])


def n_shards(train: DataFrame) -> int:
    return max(16, -(-text_bytes(train) // SHARD_BYTES))


def pair_counts(train: DataFrame, contexts: Contexts, shards: int) -> DataFrame:
    """COUNTS: the pairs of the training texts (text), a row for each shard."""
    asked = train.select("text").mapInArrow(lambda it: _pair_requests(it, contexts, shards, True), PAIRS)
    return kept(asked.groupBy("shard").applyInPandas(lambda g: _shard_counts(g, contexts.n), COUNTS), "counts")


def opened(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, word's place of each pair, context of each pair, count of each pair) of a row of COUNTS."""
    fan = unsqueeze(r["fan"])
    return unsqueeze_sorted(r["words"]), np.repeat(np.arange(len(fan)), fan), unsqueeze_lists(fan, r["context"]), unsqueeze(r["counts"]).astype(np.int64)


# arrays over contexts


def context_stats(counts: DataFrame, n: int) -> np.ndarray:
    """By context [6, n]: its tokens, and its pairs seen once, twice, three, four and more times."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for r in b.to_pylist()):
            _, _, context, c = opened(r)
            seen = [np.bincount(context[np.minimum(c, 5) == k], minlength=n) for k in (1, 2, 3, 4, 5)]
            yield ranged(r["shard"], by_range(np.bincount(context, c, n), *seen))

    return context_sums(counts.mapInArrow(each, "shard int, range int, sums binary"), last_shard(counts), 6, n)


def word_stats(counts: DataFrame) -> dict[str, int]:
    """WORD_SUMS: number of words, of words with one to four contexts, and of pairs."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for r in b.to_pylist()):
            fan = unsqueeze(r["fan"])
            sums = [len(fan), *((fan == k).sum() for k in (1, 2, 3, 4)), fan.sum()]
            yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in sums], names=[x.split(" ")[0] for x in WORD_SUMS.split(", ")])

    names = [x.split(" ")[0] for x in WORD_SUMS.split(", ")]
    row = counts.mapInArrow(each, WORD_SUMS).agg(*(F.sum(x).alias(x) for x in names)).first()
    return {x: row[x] or 0 for x in names}


def ranged(shard: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    ranges, sums = zip(*rows)
    cols = [pa.array([shard] * len(rows), pa.int32()), pa.array(ranges, pa.int32()), pa.array(sums, pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=["shard", "range", "sums"])


def by_range(*arrays: np.ndarray) -> list[tuple[int, bytes]]:
    """Integer arrays over contexts, cut into RANGES."""
    cuts = np.linspace(0, len(arrays[0]), RANGES + 1).astype(int)
    return [(k, zstandard.compress(np.stack([a[cuts[k] : cuts[k + 1]] for a in arrays]).astype(np.int64).tobytes(), 1)) for k in range(RANGES)]


def last_shard(counts: DataFrame) -> int | None:
    return counts.agg(F.max("shard")).first()[0]


def context_sums(rows: DataFrame, last: int | None, columns: int, n: int) -> np.ndarray:
    """rows (shard int, range int, sums binary) summed over shards up to the last: an array [columns, n], bounded by the number of contexts.

    Shards are summed by FAN neighbours, then these sums, and so on, so that a task has FAN arrays of a range at most, however many shards there are.
    """

    def total(group: pd.DataFrame) -> pd.DataFrame:
        out = 0
        for x in group["sums"]:
            out = out + np.frombuffer(zstandard.decompress(x), np.int64)
        return pd.DataFrame({"shard": [int(group["shard"].iloc[0])], "range": [int(group["range"].iloc[0])], "sums": [zstandard.compress(out.tobytes(), 1)]})

    while last is not None:
        rows = rows.withColumn("shard", F.expr(f"shard div {FAN}").cast("int")).groupBy("range", "shard").applyInPandas(total, "shard int, range int, sums binary")
        last = last // FAN or None
    parts = {r.range: np.frombuffer(zstandard.decompress(r.sums), np.int64).reshape(columns, -1) for r in rows.collect()}
    return np.concatenate([parts[k] for k in sorted(parts)], 1) if parts else np.zeros((columns, n), np.int64)


# replies


BLOCKS = "block long, ids array<long>, labels array<string>, n binary, ranks binary, counts binary, end int, context binary"


def _encode(batches: Iterator[pa.RecordBatch], contexts: Contexts) -> Iterator[pa.RecordBatch]:
    for number, rows in blocks(batches, "text", BLOCK_BYTES):
        h, n = tokens(rows)
        vocab, at, end = places(h)
        ids, labels = (rows.column(c).to_pylist() for c in ("doc_id", "label"))
        counts = np.bincount(at, minlength=len(vocab))
        rank = np.empty(len(vocab), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(vocab))
        row = [number, ids, labels, squeeze(n), squeeze(rank[at]), squeeze(counts), end, squeeze(contexts.of(vocab))]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), *[pa.binary()] * 3, pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[x.split(" ")[0] for x in BLOCKS.split(", ")])


def looked_up_pairs(asked: pd.DataFrame, words_: np.ndarray, code: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each request (block, place of each word among words_ or -1, place of each pair among code or -1, word of each pair by number, context of each pair)."""
    for block, w, fan, context in zip(asked["block"], asked["words"], asked["fan"], asked["context"]):
        w, fan = unsqueeze_sorted(w), unsqueeze(fan)
        context = unsqueeze_lists(fan, context)
        at = np.minimum(np.searchsorted(words_, w), max(len(words_) - 1, 0))
        at = np.where(words_[at] == w, at, -1) if len(words_) else np.full(len(w), -1)
        of = np.repeat(np.arange(len(w)), fan)
        asked_code = np.where(at[of] < 0, -1, at[of] * n + context)
        pair = np.minimum(np.searchsorted(code, asked_code), max(len(code) - 1, 0))
        pair = np.where(code[pair] == asked_code, pair, -1) if len(code) else np.full(len(of), -1)
        yield block, at, pair, of, context


def replied(docs: DataFrame, contexts: Contexts, shards: int, model: DataFrame, reply, score, schema: str) -> DataFrame:
    """score(block, replies in order of shards) for every block of docs (doc_id, label, text); the label goes along.

    reply(key, requests of a shard, model rows of the shard): (block, shard, words, pairs) with packed values for the words and the pairs asked for.
    Requests and blocks are two passes over docs that must see the same partitions; where docs has a shuffle, it is kept first.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("string").alias("label"), "text")
    if "Exchange" in rows._jdf.queryExecution().executedPlan().toString():
        rows = kept(rows, "texts")
    asked = rows.select("text").mapInArrow(lambda it: _pair_requests(it, contexts, shards, False), PAIRS).drop("counts")
    replies = asked.groupBy("shard").cogroup(model.groupBy("shard")).applyInPandas(reply, "block long, shard int, words binary, pairs binary")
    encoded = rows.mapInArrow(lambda it: _encode(it, contexts), BLOCKS)

    def each(block: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([score(b, own.sort_values("shard")) for b in block.itertuples()])

    return encoded.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(each, schema)


def opened_block(b, n_contexts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pd.Series]:
    """(words of each text, place of each token, its context, its text, distinct pairs, place of each token's pair, ids) of a block."""
    n = unsqueeze(b.n).astype(np.int64)
    at = np.argsort(-unsqueeze(b.counts).astype(np.int64), kind="stable")[unsqueeze(b.ranks)]
    place, before, text = stream(at, n, b.end, unsqueeze(b.context).astype(np.int64))
    code, pair = np.unique(coded(place, before, n_contexts), return_inverse=True)
    ids = pd.array([None if i is None or i != i else int(i) for i in b.ids], "Int64")
    return n, place, before, text, code, pair, ids
