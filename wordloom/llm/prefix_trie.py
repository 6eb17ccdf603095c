"""The trie of conversations' prefixes: how many conversations share each, and what a cache of prefixes saves.

A prefix is known by its depth and 128 bits: the sum, modulo 2^64 in either half, of what its turns' digests come to in their places.
Sums need no order of computation, so a conversation of any length is cut into segments that are summed side by side. That no two
prefixes share a digest is verified for all of them: their last turns and their parents are the same.

Every node belongs to the smallest conversation that has it. What a node adds to the nodes above it is then counted in the shard of that
conversation's segment alone, and shards hold whole segments, whatever turns they share: a shard enumerates its distinct prefixes, gives each a slot by
a minimal perfect hash, and adds up through parents' slots from the deepest to the root. Sums over shards are sums over subtrees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .shared import kept, n_words
from .words import U64, mix

SEGMENT = 1 << 16  # turns of a conversation that one shard has at once
SHARD = 1 << 18  # turns of a shard, about
PIECE = 1 << 16  # ids of a piece of a list that is hashed
COPIES = 1 << 16  # rows that one row gives rise to at once
_GOLD = U64(0x9E3779B97F4A7C15)
_KEY = ("depth", "p0", "p1")


class SlotTable:
    """A minimal perfect hash of distinct keys (depth, p0, p1), each verified against what its slot holds.

    A level has two places a key; keys alone in theirs keep it, others go on to the next level. A slot is the number of kept places before a key's.
    Keys that no level parts, as their 64-bit hashes are equal, are looked up by themselves.
    """

    LEVELS = 40

    def __init__(self, *key: np.ndarray):
        h, rest = self._hash(*key), np.arange(len(key[0]))
        self.levels, slot, used = [], np.zeros(len(h), np.int64), 0
        while len(rest) and len(self.levels) < self.LEVELS:
            place = self._place(h[rest], len(self.levels), 2 * len(rest))
            alone = np.bincount(place, minlength=2 * len(rest)) == 1
            rank = used + np.cumsum(alone) - 1
            self.levels.append((alone, rank))
            kept_ = alone[place]
            slot[rest[kept_]] = rank[place[kept_]]
            used += int(alone.sum())
            rest = rest[~kept_]
        slot[rest] = used + np.arange(len(rest))
        self.same = {tuple(int(c[k]) for c in key): int(slot[k]) for k in rest}
        self.key = [np.empty(len(h), c.dtype) for c in key]
        for own, c in zip(self.key, key):
            own[slot] = c

    @staticmethod
    def _hash(depth: np.ndarray, p0: np.ndarray, p1: np.ndarray) -> np.ndarray:
        return mix(p0 ^ mix(p1 + depth.astype(U64) * _GOLD))

    @staticmethod
    def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(h + np.full(1, level + 1, U64) * _GOLD) % U64(size)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.key[0])

    def slots(self, *key: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for one that isn't in the table."""
        h, out, rest = self._hash(*key), np.full(len(key[0]), -1), np.arange(len(key[0]))
        for level, (alone, rank) in enumerate(self.levels):
            place = self._place(h[rest], level, len(alone))
            hit = alone[place]
            out[rest[hit]] = rank[place[hit]]
            rest = rest[~hit]
        if self.same:
            out[rest] = [self.same.get(tuple(int(c[k]) for c in key), -1) for k in rest]
        held = out >= 0
        for own, c in zip(self.key, key):
            held[held] = own[out[held]] == c[held]
        return np.where(held, out, -1)


def distinct(*key: np.ndarray) -> list[np.ndarray]:
    """The distinct keys."""
    order = np.lexsort(key[::-1])
    key = [c[order] for c in key]
    new = np.append(True, np.any([c[1:] != c[:-1] for c in key], axis=0)) if len(order) else np.zeros(0, bool)
    return [c[new] for c in key]


def accumulate(table: SlotTable, parent: np.ndarray, *counts: np.ndarray) -> None:
    """Adds each slot's counts to its parent's, the deepest first; -1 is no parent here."""
    depth = table.key[0]
    order = np.argsort(-depth, kind="stable")
    cut = np.flatnonzero(np.append(True, depth[order][1:] != depth[order][:-1])) if len(order) else np.zeros(0, int)
    for level in np.split(order, cut[1:]):
        level = level[parent[level] >= 0]
        for c in counts:
            np.add.at(c, parent[level], c[level])


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, words, lo, hi): turns numbered 1, 2, ... by turn (null first), then role and text; equal rows stand next to each other.

    Equal rows are counted before anything is sorted, so that a conversation that repeats one turn is no single range. Texts go along only
    where turns of one number differ, as nothing else needs them to be ordered.
    """
    c = conversations
    rows = c.where(c["conv_id"].isNotNull()).select("conv_id", "turn", *(F.coalesce(c[x].cast("string"), F.lit("")).alias(x) for x in ("role", "text")))
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    half = lambda k: F.conv(F.substring(digest, k, 16), 16, -10).cast("long")
    rows = rows.withColumns({"lo": half(1), "hi": half(17), "words": n_words(F.col("text")).cast("long")})
    key = ["conv_id", "turn", "lo", "hi"]
    own = kept(rows.groupBy(*key, "words").agg(F.count("*").alias("n")), "turns")
    tied = own.groupBy("conv_id", "turn").agg(F.count("*").alias("differ")).where("differ > 1")
    if tied.isEmpty():
        own = own.withColumns({"role": F.lit(None).cast("string"), "text": F.lit(None).cast("string")})
    else:
        tied = tied.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"))
        texts = rows.join(tied, (F.col("conv_id") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t")), "left_semi").select(*key, "role", "text").distinct()
        texts = texts.toDF("c", "t", "l", "h", "role", "text")
        same = (F.col("conv_id") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("lo") == F.col("l")) & (F.col("hi") == F.col("h"))
        own = own.join(texts, same, "left").drop("c", "t", "l", "h")
    own = own.withColumn("many", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}"))))
    own = own.withColumn("few", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(COPIES - 1), F.col("n") - 1 - COPIES * F.col("many")))))
    rows = numbered(own.drop("n"), ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "many", "few"], "pos", within="conv_id")
    return rows.select("conv_id", "pos", "words", "lo", "hi")


def rebuilt(turns: DataFrame, family: int = 20, borrowed: int = 4) -> DataFrame:
    """(conv_id, depth, n, words, lo, hi): the turns of conversations whose first h come from conversation c - c % family, and a row of depth 0 each.

    h is the CRC-32 of the decimal id modulo borrowed; n is the number of turns after that.
    """
    turns = kept(turns, "turns")
    own = turns.groupBy("conv_id").agg(F.max("pos").alias("n_own"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % borrowed
    own = kept(own.select("conv_id", "n_own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base")), "conversations")
    bases = own.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    convs = own.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.lit(0), F.col("n_own") - F.col("h"))).alias("n"))
    convs = kept(convs, "rebuilt")
    later = turns.join(convs.hint("merge"), "conv_id").where("pos > h")
    later = later.select("conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "n", "words", "lo", "hi")
    heads = turns.where(F.col("pos") < borrowed).withColumnRenamed("conv_id", "base")
    heads = heads.join(convs.hint("merge"), "base").where("pos <= h").select("conv_id", F.col("pos").alias("depth"), "n", "words", "lo", "hi")
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", zero.alias("depth"), "n", zero.alias("words"), zero.alias("lo"), zero.alias("hi"))
    return later.unionByName(heads).unionByName(roots)


def _segment(depth: str, size: int) -> F.Column:
    return F.when(F.col(depth) > 0, F.expr(f"({depth} - 1) div {size}")).otherwise(0)


def _shard(conv: str, shards: int) -> F.Column:
    return F.pmod(F.xxhash64(conv, "segment"), F.lit(shards))


_PREFIXES = "conv_id long, depth long, n long, segment long, words long, lo long, hi long, p0 long, p1 long, q0 long, q1 long"


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    """Turns of whole segments to their prefixes within the segment (p0, p1), and those of one turn less (q0, q1)."""
    rows = rows.sort_values(["conv_id", "segment", "depth"], kind="stable", ignore_index=True)
    depth = rows["depth"].to_numpy()
    first = np.flatnonzero(np.append(True, (rows["conv_id"].to_numpy()[1:] != rows["conv_id"].to_numpy()[:-1]) | (rows["segment"].to_numpy()[1:] != rows["segment"].to_numpy()[:-1])))
    out = {}
    for k, half in enumerate(("lo", "hi")):
        part = mix(rows[half].to_numpy().view(U64) ^ mix(depth.astype(U64) * _GOLD + U64(k + 1)))
        part[depth == 0] = 0
        upto = np.cumsum(part, dtype=U64)
        upto -= np.repeat(upto[first] - part[first], np.diff(np.append(first, len(rows))))
        out[f"p{k}"], out[f"q{k}"] = upto.view(np.int64), (upto - part).view(np.int64)
    return rows.assign(**out).drop(columns="shard")


def _before(rows: pd.DataFrame) -> pd.DataFrame:
    """(conv_id, segment, p0, p1): whole segments of one conversation to the sums of all before each next one."""
    rows = rows.sort_values("segment", ignore_index=True)
    for c in ("p0", "p1"):
        rows[c] = np.cumsum(rows[c].to_numpy().view(U64), dtype=U64).view(np.int64)
    return rows.assign(segment=rows["segment"] + 1)


def prefixes(rows: DataFrame, shards: int, segment: int = SEGMENT) -> DataFrame:
    """The rows of rebuilt with segment, and the digest of each prefix (p0, p1) and of its parent (q0, q1)."""
    rows = rows.withColumn("segment", _segment("depth", segment)).withColumn("shard", _shard("conv_id", shards))
    local = kept(rows.groupBy("shard").applyInPandas(_summed, _PREFIXES), "prefixes")
    whole = local.where((F.col("depth") % segment == 0) & (F.col("depth") > 0) & (F.col("n") > F.col("depth"))).select("conv_id", "segment", "p0", "p1")
    if whole.isEmpty():
        return local
    ahead = kept(whole.groupBy("conv_id").applyInPandas(_before, whole.schema), "segments")
    ahead = ahead.select(F.col("conv_id").alias("c"), F.col("segment").alias("s"), F.col("p0").alias("a0"), F.col("p1").alias("a1"))
    names = local.columns
    joined = local.join(ahead.hint("merge"), (F.col("conv_id") == F.col("c")) & (F.col("segment") == F.col("s")), "left")

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            add = [batch.column(f"a{k}").fill_null(0).to_numpy().view(U64) for k in (0, 1)]
            new = {f"{p}{k}": pa.array((batch.column(f"{p}{k}").to_numpy().view(U64) + add[k]).view(np.int64)) for p in "pq" for k in (0, 1)}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names=names)

    return kept(joined.mapInArrow(shifted, local.schema), "prefixes")


def nodes_of(paths: DataFrame) -> DataFrame:
    """(depth, p0, p1, conv_id, n_convs, q0, q1, leaves, saved): each distinct prefix, its smallest member, and what it adds to the nodes above."""
    last = F.struct("q0", "q1", "lo", "hi")
    nodes = paths.groupBy(*_KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max(F.col("n") > F.col("depth")).alias("goes_on"),
        F.max("words").alias("words"), F.min(last).alias("least"), F.max(last).alias("most"),
    )
    nodes = kept(nodes, "nodes")
    if not nodes.where("least <> most").isEmpty():
        raise ValueError("two prefixes have the same digest")
    return nodes.select(*_KEY, "conv_id", "n_convs", "least.q0", "least.q1", F.when(F.col("goes_on"), 0).otherwise(1).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))


_ROW = (*_KEY, "q0", "q1", "conv_id", "kind", "leaves", "saved")
_PATH, _OWN, _TAIL = range(3)


def _subtrees(rows: pd.DataFrame, segment: int) -> pd.DataFrame:
    """A shard's rows to (depth, p0, p1, n_leaves, saved_tokens, n_children): what its conversations' own nodes add to each.

    Sums end where a segment begins, as what comes after it is in the rows of tails.
    """
    col = {c: rows[c].to_numpy() for c in _ROW}
    for c in ("p0", "p1", "q0", "q1"):
        col[c] = col[c].view(U64)
    kind = [np.flatnonzero(col["kind"] == k) for k in (_PATH, _OWN, _TAIL)]
    path, own, tail = kind
    table = SlotTable(*distinct(*(col[c][path] for c in _KEY)))
    slot = table.slots(*(col[c][path] for c in _KEY))
    up = table.slots(col["depth"][path] - 1, col["q0"][path], col["q1"][path])
    parent = np.full(len(table), -1)
    depth = col["depth"][path]
    parent[slot] = np.where((depth == 1) | (depth > 1) & ((depth - 1) % segment != 0), up, -1)
    leaves, saved, children = (np.zeros(len(table), np.int64) for _ in range(3))
    at = table.slots(*(col[c][own] for c in _KEY))
    np.add.at(leaves, at, col["leaves"][own])
    np.add.at(saved, at, col["saved"][own])
    inside = parent[at] >= 0
    np.add.at(children, parent[at[inside]], 1)
    if len(tail):  # what deeper segments of a conversation add to all of this one's
        where = {(int(c), int(d)): int(s) for c, d, s in zip(col["conv_id"][path], col["depth"][path], slot)}
        for k in tail:
            s = where[int(col["conv_id"][k]), int(col["depth"][k])]
            leaves[s] += col["leaves"][k]
            saved[s] += col["saved"][k]
    accumulate(table, parent, leaves, saved)
    out = own[~inside & (col["depth"][own] > 0)]  # their parents are in the segment before
    none = np.zeros(len(out), np.int64)
    some = np.flatnonzero((leaves != 0) | (saved != 0) | (children != 0))
    both = lambda a, b: np.concatenate([a, b])
    return pd.DataFrame({
        "depth": both(table.key[0][some], col["depth"][out] - 1), "p0": both(table.key[1][some], col["q0"][out]).view(np.int64), "p1": both(table.key[2][some], col["q1"][out]).view(np.int64),
        "n_leaves": both(leaves[some], none), "saved_tokens": both(saved[some], none), "n_children": both(children[some], none + 1),
    })


def _tails(rows: pd.DataFrame) -> pd.DataFrame:
    """(conv_id, segment, leaves, saved) of one conversation's segments to what all later ones have."""
    rows = rows.sort_values("segment", ascending=False, ignore_index=True)
    for c in ("leaves", "saved"):
        rows[c] = rows[c].cumsum() - rows[c]
    return rows


def subtree_sums(paths: DataFrame, nodes: DataFrame, shards: int, segment: int = SEGMENT) -> DataFrame:
    """(depth, p0, p1, n_leaves, saved_tokens, n_children) of each node."""
    none = F.lit(None).cast("long")
    own = nodes.withColumn("segment", _segment("depth", segment))
    rows = paths.select(*_KEY, "q0", "q1", "conv_id", F.lit(_PATH).alias("kind"), F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"), "segment")
    rows = rows.unionByName(own.select(*_KEY, "q0", "q1", "conv_id", F.lit(_OWN).alias("kind"), "leaves", "saved", "segment"))
    cut = paths.where(F.col("depth") > segment).select("conv_id").distinct()
    if not cut.isEmpty():
        each = own.join(cut, "conv_id").groupBy("conv_id", "segment").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        every = paths.where(F.col("depth") % segment == 0).join(cut, "conv_id", "left_semi").where((F.col("depth") > 0) & (F.col("n") > F.col("depth")))
        every = every.select("conv_id", "segment", F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))  # segments that own nothing
        each = each.select(every.columns).unionByName(every).groupBy("conv_id", "segment").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        tails = each.groupBy("conv_id").applyInPandas(_tails, each.schema).where("leaves <> 0 or saved <> 0")
        tails = tails.select(((F.col("segment") + 1) * segment).alias("depth"), *(F.lit(0).cast("long").alias(c) for c in ("p0", "p1", "q0", "q1")), "conv_id", F.lit(_TAIL).alias("kind"), "leaves", "saved", "segment")
        rows = rows.unionByName(tails)
    rows = rows.withColumn("shard", _shard("conv_id", shards)).drop("segment")
    parts = rows.groupBy("shard").applyInPandas(lambda r: _subtrees(r, segment), "depth long, p0 long, p1 long, n_leaves long, saved_tokens long, n_children long")
    return parts.groupBy(*_KEY).agg(*(F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens", "n_children")))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, p0, p1, conv_id) to (depth, p0, p1, first, ids): runs of equal keys as joined ids."""
    for batch in batches:
        depth, p0, p1, conv = (c.to_numpy() for c in batch.columns)
        new = np.append(True, (depth[1:] != depth[:-1]) | (p0[1:] != p0[:-1]) | (p1[1:] != p1[:-1]))
        start = np.flatnonzero(new)
        start = np.unique(np.concatenate([start, np.arange(0, len(conv), PIECE)])) if len(conv) else start
        ids = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(start, np.append(start[1:], len(conv)))]
        yield pa.RecordBatch.from_arrays([pa.array(x[start]) for x in (depth, p0, p1, conv)] + [pa.array(ids, pa.string())], names=[*_KEY, "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to (depth, p0, p1, ends_sha256); a list goes through the hash piece by piece and is never held whole."""
    key, digest = None, None
    for batch in batches:
        done = []
        for *now, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if now != key:
                if key:
                    done.append((*key, digest.hexdigest()))
                key, digest = now, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=[*_KEY, "ends_sha256"])
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, digest.hexdigest())], names=[*_KEY, "ends_sha256"])


def ends(paths: DataFrame, shards: int) -> DataFrame:
    """(depth, p0, p1, ends_sha256): the SHA-256 digest of the ids of conversations that end at a node, ascending and comma-joined."""
    rows = paths.where("depth = n").select(*_KEY, "conv_id")
    rows = rows.repartitionByRange(shards, *_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id")
    pieces = rows.mapInArrow(_pieces, "depth long, p0 long, p1 long, first long, ids string")
    pieces = pieces.repartition(shards, *_KEY).sortWithinPartitions(*_KEY, "first")
    return pieces.mapInArrow(_hashed, "depth long, p0 long, p1 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node; see queries for what they are.

    conversations: (conv_id, turn, role, text) and any other columns. Rows without conv_id belong to no conversation. Turns with equal numbers go by role
    and text; a row given twice is two turns. Null roles and texts are empty ones. An empty table has no node, not even a root.
    """
    paths = rebuilt(ordered_turns(conversations))
    paths = kept(paths, "paths")
    shards = max(1, -(-paths.count() // SHARD))
    paths = prefixes(paths, shards, segment)
    nodes = kept(nodes_of(paths), "trie")
    sums = kept(subtree_sums(paths, nodes, shards, segment), "subtrees")
    last = kept(ends(paths, shards), "ends")
    above = nodes.select((F.col("depth") + 1).alias("below"), F.col("p0").alias("up0"), F.col("p1").alias("up1"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(sums.hint("merge"), list(_KEY)).join(last.hint("merge"), list(_KEY), "left")
    found = found.join(above.hint("merge"), (F.col("depth") == F.col("below")) & (F.col("q0") == F.col("up0")) & (F.col("q1") == F.col("up1")) & (F.col("depth") > 0), "left")
    none = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", none)


def prefix_trie_sql() -> str:
    """prefix_trie over conversations, in DuckDB SQL."""
    from .importance import CRC_SQL, crc32_sql

    return rf"""WITH c AS ({CRC_SQL}),
o AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
g AS (SELECT conv_id, own, hex(conv_id::VARCHAR) AS id FROM o), h AS (SELECT g.conv_id, g.own, {crc32_sql("g.id")} % 4 AS h, b.own AS base FROM g LEFT JOIN o b ON b.conv_id = g.conv_id - g.conv_id % 20, c),
s AS (SELECT conv_id, coalesce(list_slice(base, 1, h), []) || list_slice(own, h + 1, len(own)) AS s FROM h),
p AS (SELECT conv_id, d, list_slice(s, 1, d) AS k, len(s) AS n FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM s)),
n AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, max(n > d) AS inner_, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM p GROUP BY d, k),
f AS (SELECT *, (n_convs - 1) * coalesce(len(regexp_extract_all(k[d].t, '[^\x20\x09-\x0D]+')), 0) AS saved, CASE WHEN inner_ THEN 0 ELSE 1 END AS leaf FROM n),
a AS (SELECT list_slice(k, 1, a) AS k, sum(saved) AS saved_tokens, sum(leaf) AS n_leaves, count(*) FILTER (d = a + 1) AS n_children FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM f) GROUP BY 1)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN a USING (k) LEFT JOIN n u ON u.d = n.d - 1 AND u.k = list_slice(n.k, 1, n.d - 1)"""
