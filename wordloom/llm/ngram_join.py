"""N-gram Jaccard join with signature trees.

A document is the set of its distinct word shingles; two link when
100 * |intersection| >= threshold * |union|. The join is exact and works in four steps:

1. Families. Shingles are ordered from rare to common in the whole table. Two sets that link share a shingle of their prefixes, the
   first n - ceil(threshold * n / 100) + 1 of n shingles. Sets that share one fall into one family (components of that relation), so every
   link lies in a family. Passages that many texts repeat come last in the order and make no families. How often a
   shingle occurs is counted over shards: blocks of texts send short fingerprints of their shingles and get the counts back; fingerprints
   that collide change the order, which stays the same for all sets, and so never the result.
2. Signature trees. A family's distinct sets become leaves, ordered by size; every node holds
   the OR of the token bitmaps below it and the range of set sizes.
3. Dual traversal. Pairs of nodes are pruned when their size ranges can't meet the threshold or
   when the largest possible overlap, the bits both have and the shingles that share a bit, is
   too small. Pairs of leaves already in one component are passed over; the rest are compared exactly.
4. A family beyond LEAVES sets is cut into trees of that size. Each tree is joined with itself;
   then one set of each component found goes on to further trees. At last every set outside its family's largest component meets the sets of
   near size in all the other trees, if that sends sets to SPREAD times their size of trees at most. Where shingles recur a family may be the whole table, and that would grow
   with its square: there, sets of different components that share a prefix shingle and are of near size meet. A shingle that few such sets have makes
   pairs of them, which are compared once however many shingles they share; others make trees of their own, dealt by size beyond LEAVES sets.
   Either way all links are found, and work follows sets or their prefixes.
   So no task holds a whole large family or list, copies are not expanded into pairs, and no link between components is lost.

Texts and shingles are known by 64-bit hashes. Two texts of one hash count as equal.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import kept, looked_up, text_bytes
from .token_blocks import squeeze, squeeze_sorted, unsqueeze, unsqueeze_sorted
from .words import U64, blocks, chunks, cut, shingle_sets, shingles, words

SHARD_BYTES = 12 << 20  # of text for each shard of fingerprints
BLOCK_BYTES = 6 << 20  # of text in memory at once
SPARE_BITS = 6  # of a fingerprint, beyond what numbers the table's shingles: so few of them collide
LEAVES = 512  # sets in one tree at most
FANOUT = 8
SPREAD = 16  # times their own size that sets are dealt to trees of families; where that doesn't do, they meet by shingles
FEW = 8  # sets with a prefix shingle in common that are compared in pairs
SIZE_STEP = 1.1  # ratio of the sizes by which a large family's sets are dealt at last


def _distinct(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, row of each), each shingle of a row once, in order of rows and shingles."""
    xs, rows = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for at, _, data, offsets in chunks(column):
        x, of = shingles(*words(data, offsets), shingle)
        order = np.lexsort((x, of))
        x, of = x[order], of[order]
        fresh = np.append(True, (x[1:] != x[:-1]) | (of[1:] != of[:-1]))[: len(x)]
        xs.append(x[fresh])
        rows.append(of[fresh] + at)
    return np.concatenate(xs), np.concatenate(rows)


def _fingerprints(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct fingerprints in order, place of each shingle's)."""
    return np.unique(x >> U64(64 - bits), return_inverse=True)


ASKED = "shard int, block long, prints binary, times binary"


def _asked(batches: Iterator[pa.RecordBatch], shingle: int, bits: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Texts to a row for each block and shard: sorted fingerprints as differences, and how many of the block's texts have each.

    Shards are ranges of fingerprints; a shard without fingerprints of the block has no row, so there are never more rows than fingerprints.
    """
    for number, rows in blocks(batches, "text", BLOCK_BYTES):
        prints, at = _fingerprints(_distinct(rows.column("text"), shingle)[0], bits)
        times = np.bincount(at, minlength=len(prints))
        ends = np.searchsorted((prints * U64(shards)) >> U64(bits), np.arange(shards + 1, dtype=U64))
        full = np.flatnonzero(np.diff(ends))
        packed = [(squeeze_sorted(prints[ends[k] : ends[k + 1]]), squeeze(times[ends[k] : ends[k + 1]])) for k in full]
        cols = [pa.array(full.astype(np.int32)), pa.array([number] * len(full), pa.int64()), *(pa.array(c, pa.binary()) for c in (zip(*packed) if packed else ([], [])))]
        yield pa.RecordBatch.from_arrays(cols, names=["shard", "block", "prints", "times"])


def _answered(group: pd.DataFrame) -> pd.DataFrame:
    """(block, shard, ranks): how common each fingerprint asked for is, from 1 for one text to 255; steps of a twelfth of a doubling from 64 on."""
    prints = [unsqueeze_sorted(x) for x in group["prints"]]
    every, at = np.unique(np.concatenate(prints), return_inverse=True)
    n = np.bincount(at, np.concatenate([unsqueeze(x) for x in group["times"]]), len(every))
    rank = np.where(n < 64, n, np.minimum(64 + 12 * np.log2(np.maximum(n, 64) / 64), 255)).astype(np.uint8)[at]
    ends = np.append(0, np.cumsum([len(x) for x in prints]))
    ranks = [zstandard.compress(rank[ends[k] : ends[k + 1]].tobytes(), 3) for k in range(len(prints))]
    return pd.DataFrame({"block": group["block"], "shard": group["shard"], "ranks": ranks})


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to a row for each block, packed."""
    for number, rows in blocks(batches, "text", BLOCK_BYTES):
        text = rows.column("text").cast(pa.large_string()).fill_null("")
        size = pc.binary_length(text).to_numpy(zero_copy_only=False)
        whole = zstandard.compress(b"".join(x.as_buffer() for x in text.cast(pa.large_binary()) if len(x.as_buffer())), 3)
        cols = [pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in (rows.column("h").to_numpy().tobytes(), size.astype(np.int64).tobytes(), whole))]
        yield pa.RecordBatch.from_arrays(cols, names=["block", "h", "size", "texts"])


def prefix_lengths(n: np.ndarray, threshold: int) -> np.ndarray:
    return n + (-threshold * n // 100) + 1


def _prefixes(block: pd.DataFrame, answers: pd.DataFrame, shingle: int, bits: int, threshold: int) -> pd.DataFrame:
    """(x, h): the prefix shingles of a block's texts that other texts may have, too."""
    out = [pd.DataFrame({"x": np.zeros(0, np.int64), "h": np.zeros(0, np.int64)})]
    for b in block.itertuples():
        h, ends = np.frombuffer(b.h, np.int64), np.append(0, np.cumsum(np.frombuffer(b.size, np.int64)))
        texts = pa.Array.from_buffers(pa.large_string(), len(h), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(zstandard.decompress(b.texts))])
        x, row = _distinct(texts, shingle)
        if not len(x):
            continue
        _, at = _fingerprints(x, bits)
        rank = np.concatenate([np.frombuffer(zstandard.decompress(a), np.uint8) for a in answers.sort_values("shard")["ranks"]])[at]
        order = np.lexsort((x, rank, row))  # of equal ranks by hash
        n = np.bincount(row, minlength=len(h))
        place = np.arange(len(x)) - (np.cumsum(n) - n)[row]
        go = order[(place < prefix_lengths(n, threshold)[row]) & (rank[order] > 1)]
        out.append(pd.DataFrame({"x": x[go].view(np.int64), "h": h[row[go]]}))
    return pd.concat(out)


def families(texts: DataFrame, shingle: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """((node, label), (x, h)): hashes of texts (h, text) that share a prefix shingle, directly or by others, and their family; the prefix shingles of each.

    Questions and blocks are two passes over texts that must see the same partitions; where texts has a shuffle, it is kept first.
    """
    if "Exchange" in texts._jdf.queryExecution().executedPlan().toString():
        texts = kept(texts, "texts")
    size = text_bytes(texts)
    shards, bits = max(16, -(-size // SHARD_BYTES)), min(60, max(24, int(size // 4 + 1).bit_length() + SPARE_BITS))
    asked = texts.select("h", "text").mapInArrow(lambda it: _asked(it, shingle, bits, shards), ASKED)
    answers = asked.groupBy("shard").applyInPandas(_answered, "block long, shard int, ranks binary")
    packed = texts.select("h", "text").mapInArrow(_held, "block long, h binary, size binary, texts binary")
    found = packed.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(lambda b, a: _prefixes(b, a, shingle, bits, threshold), "x long, h long")
    found = kept(found, "prefixes")
    heads = found.groupBy("x").agg(F.min("h").alias("head"), F.max("h").alias("last")).where("head < last").select("x", "head")
    links = found.join(kept(heads, "heads"), "x").where("h <> head").select(F.col("head").alias("a"), F.col("h").alias("b"))
    return components(links), found


class SignatureTree:
    """Levels of nodes over sets ordered by size: level 0 has the sets, the last one the root.

    bits: OR of the bitmaps below; low, high: sizes below; extra: most shingles of a set below
    that share a bit with another of its own, so that an overlap is at most common bits + extra.
    """

    def __init__(self, sets: list[np.ndarray]):
        n = np.array([len(s) for s in sets])
        width = max(64, 1 << int(2 * n.max() - 1).bit_length())
        bits = np.zeros((len(sets), width // 8), np.uint8)
        for i, s in enumerate(sets):
            on = np.zeros(width, bool)
            on[(s >> U64(64 - (width.bit_length() - 1))).astype(np.int64)] = True
            bits[i] = np.packbits(on)
        bits = bits.view(U64)
        self.levels = [(bits, n, n, n - np.bitwise_count(bits).sum(1, dtype=np.int64))]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, extra = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bits, at, 0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(extra, at)))

    def may_link(self, level: int, i: np.ndarray, j: np.ndarray, threshold: int) -> np.ndarray:
        bits, low, high, extra = self.levels[level]
        ok = (100 * high[i] >= threshold * low[j]) & (100 * high[j] >= threshold * low[i])
        keep = np.flatnonzero(ok)
        for at in range(0, len(keep), 4096):
            k = keep[at : at + 4096]
            most = np.bitwise_count(bits[i[k]] & bits[j[k]]).sum(1, dtype=np.int64) + np.minimum(extra[i[k]], extra[j[k]])
            ok[k] = (100 + threshold) * most >= threshold * (low[i[k]] + low[j[k]])
        return ok

    def leaf_pairs(self, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Dual traversal of the tree with itself: pairs of leaves i < j that no bound rules out."""
        i = j = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, 0, -1):
            ok = self.may_link(level, i, j, threshold)
            i, j = i[ok], j[ok]
            below = len(self.levels[level - 1][1])
            step = np.arange(FANOUT)
            ii = np.repeat(i[:, None] * FANOUT + step, FANOUT, 1).ravel()
            jj = np.tile(j[:, None] * FANOUT + step, (1, FANOUT)).ravel()
            keep = (ii < below) & (jj < below) & (ii <= jj)
            i, j = ii[keep], jj[keep]
        apart = i < j
        i, j = i[apart], j[apart]
        ok = self.may_link(0, i, j, threshold)
        return i[ok], j[ok]


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def tree_join(sets: list[np.ndarray], group: np.ndarray, threshold: int, side: np.ndarray | None = None) -> np.ndarray:
    """Group numbers after joining sets that link. Sets of one group count as linked; with sides, two of side 0 aren't compared."""
    up: dict[int, int] = {int(g): int(g) for g in group}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    order = np.array(sorted(range(len(sets)), key=lambda i: len(sets[i])))
    tree = SignatureTree([sets[i] for i in order])
    for x, y in zip(*(order[p] for p in tree.leaf_pairs(threshold))):
        a, b = root(int(group[x])), root(int(group[y]))
        if a == b or side is not None and not side[x] and not side[y]:
            continue
        both = _overlap(sets[x], sets[y])
        if 100 * both >= threshold * (len(sets[x]) + len(sets[y]) - both):
            up[max(a, b)] = min(a, b)
    return np.array([root(int(g)) for g in group], np.int64)


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in cut(whole, "text", BLOCK_BYTES)):
        packed = pa.array([s.tobytes() for s in shingle_sets(batch.column("text"), shingle)], pa.binary())
        rest = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), packed], names=[*rest, "set"])


def _join_trees(rows: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tree (family, chunk): (h, label, set, side) to (h, label, new label, best), one tree in memory at a time."""
    held: list[tuple] = []

    def done() -> pa.RecordBatch:
        h, label = (np.array([r[k] for r in held], np.int64) for k in (1, 2))
        sets = [np.frombuffer(r[3], U64) for r in held]
        side = np.array([r[4] for r in held], bool)
        new = tree_join(sets, label, threshold, None if side.all() else side)
        best = np.zeros(len(h), bool)
        for g in np.unique(new):
            own = np.flatnonzero(new == g)
            best[own[0] if len(own) < 3 else own[_middle([sets[i] for i in own])]] = True
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(label), pa.array(new), pa.array(best)], names=["h", "label", "new", "best"])

    for batch in rows:
        for row in zip(*(batch.column(c).to_pylist() for c in ("tree", "h", "label", "set", "side"))):
            if held and held[0][0] != row[0]:
                yield done()
                held = []
            held.append(row)
    if held:
        yield done()


def _middle(sets: list[np.ndarray]) -> int:
    """The set with most shingles, counted by how many of the sets have them, for its size."""
    every, count = np.unique(np.concatenate(sets), return_counts=True)
    return int(np.argmax([count[np.searchsorted(every, s)].sum() / (len(s) + len(sets) / 2) for s in sets]))


def _trees(rows: DataFrame, threshold: int) -> DataFrame:
    """rows: (tree, h, label, set, side)."""
    dealt = rows.repartition("tree").sortWithinPartitions("tree", "h")
    return dealt.mapInArrow(lambda it: _join_trees(it, threshold), "h long, label long, new long, best boolean")


def linked(texts: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """(h, label) for the text hashes that have links; h - label is the component. texts: (h, text)."""
    family, prefixes = families(texts, shingle, threshold)
    near = texts.join(looked_up(family, "families"), texts.h == F.col("node"))
    rows = near.groupBy("h", F.col("label").alias("family")).agg(F.first("text").alias("text"))  # equal texts of a task are one
    rows = rows.select("family", "h", "text")
    sets = kept(rows.mapInArrow(lambda it: _sets(it, shingle), "family long, h long, set binary"), "sets")
    sets = _counted(sets)
    tree = lambda salt: F.xxhash64("family", F.when(F.col("chunks") > 1, F.pmod(F.xxhash64(F.col("h"), F.lit(salt)), "chunks")).otherwise(0))
    first = kept(_trees(sets.select(tree(0).alias("tree"), "h", F.col("h").alias("label"), "set", F.lit(True).alias("side")), threshold), "joined")
    links = first.select(F.col("h").alias("a"), F.col("new").alias("b"))
    large = sets.where("chunks > 1").drop("chunks")
    if not large.isEmpty():
        links = links.unionByName(_large(large, prefixes, links, first.where("best").select("h"), threshold))
    return components(links)


def _counted(sets: DataFrame) -> DataFrame:
    """sets with the number of trees of their family. Small tables are looked up, so that the sets themselves stay where they are."""
    sizes = sets.groupBy("family").agg(F.ceil(F.count("*") / LEAVES).cast("int").alias("chunks"))
    return sets.join(looked_up(sizes, "sizes"), "family")


def _labelled(sets: DataFrame, links: DataFrame) -> DataFrame:
    label = looked_up(components(links), "components")
    return sets.join(label, sets.h == F.col("node"), "left").drop("node").withColumn("label", F.coalesce("label", "h"))


def _large(sets: DataFrame, prefixes: DataFrame, links: DataFrame, best: DataFrame, threshold: int) -> DataFrame:
    """Links between the trees of families of more than LEAVES sets. prefixes: (x, h)."""
    found = links.limit(0)
    for salt in (1, 2):  # one set of each component, dealt into trees again
        own = _counted(_labelled(sets.join(looked_up(best, "best"), "h", "left_semi"), links.unionByName(found)))
        tree = F.xxhash64("family", F.pmod(F.xxhash64(F.col("h"), F.lit(salt)), "chunks"))
        step = kept(_trees(own.select(tree.alias("tree"), "h", "label", "set", F.lit(True).alias("side")), threshold), "joined")
        found = found.unionByName(step.select(F.col("label").alias("a"), F.col("new").alias("b")))
        best = step.where("best").select("h")
    own = kept(_labelled(sets, links.unionByName(found)).select("family", "h", "label", "set"), "labelled")
    size = F.expr("octet_length(set) div 8")
    whole = own.select(F.col("family").alias("x"), "h", "label", size.alias("m"), F.floor(F.log(size) / math.log(SIZE_STEP)).cast("int").alias("z"))
    n = whole.groupBy(F.col("x").alias("of")).agg(F.count("*").alias("n"), F.count_distinct("label").alias("parts")).where("parts > 1").drop("parts")
    whole = whole.join(looked_up(n, "lists"), F.col("x") == F.col("of")).drop("of")
    rows = kept(_dealt(whole, threshold), "dealt")
    spread = rows.join(whole.select("h", "m"), "h").agg(F.sum("m")).first()[0] or 0
    if spread > SPREAD * (own.agg(F.sum(size)).first()[0] or 0):  # families too large to meet as a whole
        posted = _posted(own, prefixes, threshold)
        found = found.unionByName(_paired(posted.where(F.col("n") <= FEW), own, threshold))
        rows = _dealt(posted.where(F.col("n") > FEW), threshold)
    rows = rows.join(own.select("h", "set").hint("merge"), "h")
    step = kept(_trees(rows, threshold), "joined")
    return found.unionByName(step.select(F.col("label").alias("a"), F.col("new").alias("b")))


def _reach(threshold: int) -> int:
    """How many size zones apart two sets that link may be."""
    return int(math.log(100 / threshold) / math.log(SIZE_STEP)) + 1


def _posted(own: DataFrame, prefixes: DataFrame, threshold: int) -> DataFrame:
    """(x, h, label, m, z, n) of sets (h, label, set): their size m and zone of size z, for each shingle x of a prefix (x, h) that a set of another component and near size has, too.

    n is how many such sets x has.
    """
    sized = own.select("h", "label", F.expr("octet_length(set) div 8").alias("m"))
    sized = sized.withColumn("z", F.floor(F.log("m") / math.log(SIZE_STEP)).cast("int"))
    posted = kept(prefixes.distinct().join(sized.hint("merge"), "h"), "posted")
    near = F.explode(F.sequence(F.col("z") - _reach(threshold), F.col("z") + _reach(threshold))).alias("at")
    zones = posted.groupBy("x", "z").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    around = zones.select("x", near, "low", "high").groupBy("x", "at").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
    posted = kept(posted.join(around.select(F.col("x").alias("of"), "at"), (F.col("x") == F.col("of")) & (F.col("z") == F.col("at"))).drop("of", "at"), "posted")
    n = posted.groupBy(F.col("x").alias("of")).agg(F.count("*").alias("n"))
    return kept(posted.join(kept(n, "lists").hint("merge"), F.col("x") == F.col("of")).drop("of"), "posted")


def _paired(posted: DataFrame, own: DataFrame, threshold: int) -> DataFrame:
    """(a, b): links of sets of two components that have a shingle of FEW sets at most in common."""
    lists = posted.groupBy("x").agg(F.collect_list(F.struct("h", "label", "m")).alias("sets"))
    pairs = lists.select(F.explode("sets").alias("p"), "sets").select("p", F.explode("sets").alias("q")).where("p.h < q.h and p.label <> q.label")
    pairs = pairs.where((100 * F.col("p.m") >= threshold * F.col("q.m")) & (100 * F.col("q.m") >= threshold * F.col("p.m")))
    pairs = kept(pairs.select(F.col("p.h").alias("g"), F.col("q.h").alias("h"), F.col("p.label").alias("a"), F.col("q.label").alias("b")).distinct(), "pairs")
    left = own.select(F.col("h").alias("g"), F.col("set").alias("one"))
    both = pairs.join(left.hint("merge"), "g").join(own.select("h", F.col("set").alias("other")).hint("merge"), "h").select("a", "b", "one", "other")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                common = _overlap(x, y)
                keep.append(100 * common >= threshold * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return kept(both.mapInArrow(compared, "a long, b long"), "compared")


def _dealt(posted: DataFrame, threshold: int) -> DataFrame:
    """(tree, h, label, side) of rows (x, h, label, m, z, n): the n sets of a family or shingle x are a tree.

    Sets of its largest component have side False, as they needn't meet each other. Of more than LEAVES sets there are several trees: sets are
    dealt by size, and those of side True go along with all of the sizes that can link.
    """
    share = posted.groupBy("x", "label").agg(F.count("*").alias("k"))
    main = share.groupBy("x").agg(F.max_by("label", F.struct("k", "label")).alias("main"))
    main = kept(main.select(F.col("x").alias("of"), "main"), "main").hint("merge")
    posted = kept(posted.join(main, F.col("x") == F.col("of")).drop("of").withColumn("side", F.col("label") != F.col("main")), "posted")
    small = posted.where(F.col("n") <= LEAVES).select(F.xxhash64("x").alias("tree"), "h", "label", "side")
    long = posted.where(F.col("n") > LEAVES)
    if long.isEmpty():
        return small
    reach = _reach(threshold)
    counts = long.groupBy(F.col("x").alias("of"), F.col("z").alias("size")).agg(
        F.ceil(F.count("*") / LEAVES).cast("int").alias("chunks"), F.ceil(F.count_if("side") / (LEAVES // 2)).cast("int").alias("blocks")
    )
    counts = looked_up(counts, "counts")
    there = lambda rows, size: rows.join(counts, (F.col("x") == F.col("of")) & (F.col(size) == F.col("size"))).drop("of", "size")
    near = F.explode(F.sequence(F.col("z") - reach, F.col("z") + reach))
    hashed = lambda salt, n: F.pmod(F.xxhash64(F.col("h"), F.lit(salt)), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    every = there(long, "z").withColumn("chunk", hashed(3, F.col("chunks"))).drop("chunks", "blocks").withColumns({"ze": F.col("z"), "zo": near})
    every = there(every, "zo").where("blocks > 0").withColumn("block", each("blocks"))
    asked = there(long.where("side"), "z").withColumn("block", hashed(4, F.col("blocks"))).drop("chunks", "blocks").withColumns({"zo": F.col("z"), "ze": near})
    asked = there(asked, "ze").withColumn("chunk", each("chunks"))
    cols = [F.xxhash64("x", "ze", "chunk", "zo", "block").alias("tree"), "h", "label"]
    return small.unionByName(every.select(*cols, F.lit(False).alias("side"))).unionByName(asked.select(*cols, F.lit(True).alias("side")))


def shingle_counts(column: pa.Array, k: int) -> list[int]:
    out = []
    for _, _, data, offsets in chunks(column):
        x, of = shingles(*words(data, offsets), k)
        order = np.lexsort((x, of))
        x, of = x[order], of[order]
        fresh = np.append(True, (x[1:] != x[:-1]) | (of[1:] != of[:-1]))[: len(x)]
        out += np.bincount(of[fresh], minlength=len(offsets) - 1).tolist()
    return out


def _counts(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = pa.array(shingle_counts(batch.column(2), shingle), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], names=["doc_id", "h", "n_shingles"])


def text_hash(text: Column) -> Column:
    """The hash by which equal texts are one; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(text, F.octet_length(text))


def rooted(docs: DataFrame, shingle: int = 5, threshold: int = 80) -> DataFrame:
    """(doc_id, h, n_shingles, root) for every row of docs (doc_id, text): its text's hash and its component.

    Rows without shingles have no links, even if they share a root.
    """
    text = F.coalesce("text", F.lit(""))
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("h"), text.alias("text"))
    label = linked(hashed.select("h", "text"), shingle, threshold)
    rows = hashed.mapInArrow(lambda it: _counts(it, shingle), "doc_id long, h long, n_shingles long")
    return rows.join(label, rows.h == label.node, "left").select("doc_id", "h", "n_shingles", F.coalesce("label", "h").alias("root"))


def ngram_jaccard_join(docs: DataFrame, shingle: int = 5, threshold: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id reachable by links. Empty or null texts and texts
    without words have n_shingles 0 and no links: component_id is their own doc_id. A text with
    fewer words than a shingle is one shingle. Rows with the same text link; a row given twice
    comes out twice. A null doc_id stays null, takes part in links, and never is the smallest;
    a component of null ids alone has a null component_id. No rows in, none out.
    """
    rows = kept(rooted(docs, shingle, threshold).drop("h"), "rooted")
    least = rows.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("members"))
    least = kept(least.where("members > 1").select(F.col("root").alias("of"), "least"), "least")
    joined = rows.join(least, (rows.root == least.of) & (rows.n_shingles > 0), "left")
    one = F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return joined.select("doc_id", "n_shingles", one.alias("component_id"))
