"""Language model scoring with a hierarchical Pitman-Yor model.

Every context (token_blocks) is a restaurant whose dishes are the words that follow it; all these restaurants share one parent, the
restaurant of single words, whose base is uniform over all words and one unknown. Customers of a restaurant are tokens, and its tables are
customers of the parent. Every training word is a dish of its own, every training token a customer.

Seating is sampled by Gibbs. A step takes all customers of a dish from a restaurant and seats them anew: as predictions need the number of
their tables alone, that number is drawn from its distribution given all other tables, in which generalised Stirling numbers sum over the ways
to seat the customers at so many tables. The cost of a sweep is therefore in dishes, and no customer keeps a seat that nothing sampled. The parent's
seating goes on from sweep to sweep in the same way. Shards of dishes work side by side: in a round of one or two sweeps each sees the other
shards' tables as they stood before the round. Predictive probabilities are averaged over the last SAMPLES rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import dropped, kept
from .token_blocks import COUNTS, by_range, context_stats, context_sums, contexts_of, last_shard, looked_up_pairs, n_shards, opened, opened_block, pair_counts, replied, squeeze, unsqueeze, word_stats

STRENGTH = 1.0
BURN_IN, SAMPLES = 2, 4  # rounds
SWEEPS = 2  # of a round of the burn-in; the others have one
EXACT = 256  # a power of two: customers up to which Stirling numbers come from their recursion
SERIES, TERMS = 1.2, 64  # tables over c^d / d up to which larger numbers come from a series, and its terms
STEPS = 12  # Metropolis steps for the tables of a dish with more customers
SEED = 20


def discount(once: int, twice: int) -> float:
    """The discount that the numbers of types seen once and twice suggest."""
    return min(max(once / (once + 2 * twice), 0.2), 0.9) if once else 0.5


def lgamma(x: np.ndarray) -> np.ndarray:
    """Log of the gamma function of positive numbers, by Stirling's series from 8 on."""
    x = np.asarray(x, float)
    low = np.zeros_like(x)
    small = x < 8
    y = np.where(small, x + 8, x)
    for k in range(8):
        low = low + np.where(small, np.log(x + k), 0)
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - z * (1 / 360 - z / 1260)) / y - low


@lru_cache(4)
def stirling(d: float) -> np.ndarray:
    """[c, t]: logs of the generalised Stirling numbers for c up to EXACT; -inf where t is 0 or more than c."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0
    t = np.arange(1, EXACT + 1)
    for c in range(1, EXACT):
        stay = out[c, 1:] + np.log(np.maximum(c - d * t, 1e-300))
        out[c + 1, 1:] = np.logaddexp(out[c, :-1], np.where(t <= c, stay, -np.inf))
    return out


def stirling_many(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """As stirling for more customers. d^t t! / c! times the number is the coefficient of x^c in (1 - (1 - x)^d)^t.

    Up to SERIES / d times c^d tables the binomial series of the power gives it, whose terms fall off; beyond, where many tables are of like
    sizes, the saddle point does. Exact at t = 1 and t = c.
    """
    c, t = np.asarray(c, float), np.asarray(t, float)
    out, many = np.zeros(len(c)), t > SERIES / d * c**d
    out[~many], out[many] = _by_series(c[~many], t[~many], d), _by_saddle(c[many], t[many], d)
    out += lgamma(c + 1) - lgamma(t + 1) - t * np.log(d)
    return np.where(t >= c, 0.0, np.where(t == 1, lgamma(c - d) - lgamma(np.full(1, 1 - d)), out))


def _by_series(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    j = np.arange(1, TERMS + 1)
    some = np.minimum(j, t[:, None])  # beyond t a term is nought
    log = lgamma(t + 1)[:, None] - lgamma(some + 1) - lgamma(t[:, None] - some + 1) + lgamma(1 + d * j) + lgamma(c[:, None] - d * j) - lgamma(c + 1)[:, None]
    sign = np.where(j <= t[:, None], (-1.0) ** (j + 1) * np.sin(np.pi * d * j), 0) / np.pi
    top = log.max(1, keepdims=True)
    return top[:, 0] + np.log(np.maximum((sign * np.exp(log - top)).sum(1), 1e-300))


def _by_saddle(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    mean = np.log(np.maximum(c / t, 1 + 1e-9))
    low, high = np.full(len(c), -200.0), np.full(len(c), -1e-12)
    for _ in range(60):  # the tilt y in (0, 1), in logs: the mean table size falls as y grows
        u = (low + high) / 2
        larger = np.log(d) + (d - 1) * u + np.log(-np.expm1(u)) - np.log(-np.expm1(d * u)) > mean
        low, high = np.where(larger, u, low), np.where(larger, high, u)
    u = (low + high) / 2
    y, yd = np.exp(u), np.exp(d * u)
    slope = (d - 1) - y / -np.expm1(u) + d * yd / -np.expm1(d * u)
    spread = -np.expm1(u) * (c / t) / y * -slope
    return t * np.log(-np.expm1(d * u)) - c * np.log(-np.expm1(u)) - 0.5 * np.log(2 * np.pi * t * np.maximum(spread, 1e-12))


def draw_tables(c: np.ndarray, t: np.ndarray, others: np.ndarray, log_p: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables, drawn anew, of dishes with c customers, now at t tables, in restaurants with so many other tables.

    log_p: log of the parent's probability of the dish. P(t) is in proportion to p^t S(c, t) times the product of STRENGTH + d (others + i), i < t.
    Up to EXACT customers the draw is exact; beyond, STEPS Metropolis steps from t leave the same distribution as it is.
    """
    out = np.ones(len(c), np.int64)
    two = np.flatnonzero(c == 2)
    odds = (STRENGTH + d * (others[two] + 1)) * np.exp(log_p[two]) / (1 - d)
    out[two] += rng.random(len(two)) * (1 + odds) < odds
    low = 2
    while low < EXACT:
        high = 2 * low
        own = np.flatnonzero((c > low) & (c <= high))
        for at in range(0, len(own), max(1, (1 << 21) // high)):
            k = own[at : at + max(1, (1 << 21) // high)]
            log = np.cumsum(np.log(STRENGTH + d * (others[k, None] + np.arange(high))) + log_p[k, None], 1) + stirling(d)[c[k], 1 : high + 1]
            total = np.cumsum(np.exp(log - log.max(1, keepdims=True)), 1)
            out[k] = 1 + (total < rng.random((len(k), 1)) * total[:, -1:]).sum(1)
        low = high
    many = np.flatnonzero(c > EXACT)
    if len(many):
        n, now, base = c[many], t[many].astype(np.int64), STRENGTH / d + others[many]

        def weight(x: np.ndarray) -> np.ndarray:
            return x * (log_p[many] + np.log(d)) + lgamma(base + x) - lgamma(base) + stirling_many(n, x, d)

        log = weight(now)
        for step in range(STEPS):
            scale = np.where(step % 3 == 0, 1 + n / 8, 1 + np.sqrt(n)) if step % 3 < 2 else np.full(len(n), 2.0)
            size = 1 + np.floor(rng.exponential(1, len(n)) * scale).astype(np.int64)  # as likely there as back
            new = now + np.where(rng.random(len(n)) < 0.5, size, -size)
            fits = (new >= 1) & (new <= n)
            log_new = np.where(fits, weight(np.clip(new, 1, n)), -np.inf)
            goes = np.log(rng.random(len(n))) < log_new - log
            now, log = np.where(goes, new, now), np.where(goes, log_new, log)
        out[many] = now
    return out


class Levels:
    """What shards know of each other: tables and customers by context, the parent's tables and customers, discounts and number of words."""

    def __init__(self, customers: np.ndarray, tables: np.ndarray, own: float, parent: float, types: int):
        self.customers, self.tables, self.own, self.parent, self.types = customers, tables, own, parent, types
        self.seated, self.parent_tables = int(tables.sum()), types

    def back(self) -> np.ndarray:
        return (STRENGTH + self.own * self.tables) / (STRENGTH + self.customers)

    def single(self, m: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The parent's probabilities of words with m customers at t tables there; of an unknown word for zeros."""
        return (m - self.parent * t + (STRENGTH + self.parent * self.parent_tables) / (self.types + 1)) / (STRENGTH + self.seated)


STATE = COUNTS + ", t binary, w binary, samples array<binary>, ranges array<struct<range int, sums binary>>, seated long, parent_tables long"


def _round(batches: Iterator[pa.RecordBatch], levels: Levels, number: int, sample: bool) -> Iterator[pa.RecordBatch]:
    """A round of sweeps over a shard. t: tables of the pairs seen more than once; w: of the words in the parent."""
    for r in (r for b in batches for r in b.to_pylist()):
        _, of, context, c = opened(r)
        rng = np.random.default_rng([SEED, number, r["shard"]])
        types, multi = int(of[-1]) + 1, np.flatnonzero(c > 1)
        t, w = np.ones(len(c), np.int64), np.ones(types, np.int64)
        if r["t"] is not None:
            t[multi], w = unsqueeze(r["t"]), unsqueeze(r["w"]).astype(np.int64)
        tables, parent_tables, o, x = levels.tables.copy(), levels.parent_tables, of[multi], context[multi]
        m, uniform = np.bincount(of, t, types).astype(np.int64), np.full(types, -np.log(levels.types + 1))
        for _ in range(1 if sample else SWEEPS):
            rest = m[o] - t[multi]  # without the dish's own tables
            p = (rest - levels.parent * np.minimum(w[o], rest) + (STRENGTH + levels.parent * parent_tables) / (levels.types + 1)) / (STRENGTH + levels.seated)
            new = draw_tables(c[multi], t[multi], tables[x] - t[multi], np.log(p), levels.own, rng)
            tables += np.bincount(x, new - t[multi], len(tables)).astype(np.int64)
            t[multi] = new
            m = np.bincount(of, t, types).astype(np.int64)
            new = draw_tables(m, np.minimum(w, m), parent_tables - w, uniform, levels.parent, rng)
            parent_tables, w = parent_tables + int(new.sum() - w.sum()), new
        samples = (r["samples"] or []) + ([squeeze(t[multi]), squeeze(m), squeeze(w)] if sample else [])
        ranges = [{"range": k, "sums": s} for k, s in by_range(np.bincount(context, t, len(tables)))]
        row = [*(r[k.split(" ")[0]] for k in COUNTS.split(", ")), squeeze(t[multi]), squeeze(w), samples, ranges, int(m.sum()), int(w.sum())]
        kinds = [pa.int32(), *[pa.binary()] * 6, pa.list_(pa.binary()), pa.list_(pa.struct([("range", pa.int32()), ("sums", pa.binary())])), pa.int64(), pa.int64()]
        names = [*(k.split(" ")[0] for k in COUNTS.split(", ")), "t", "w", "samples", "ranges", "seated", "parent_tables"]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)


def sampled(counts: DataFrame, levels: Levels, n: int) -> tuple[DataFrame, list[np.ndarray], list[tuple[int, int]]]:
    """(shards with their samples, weights of the parent by context for each sample, (parent's customers, tables) for each sample)."""
    context, last = counts.sparkSession.sparkContext, last_shard(counts)
    none = [F.lit(None).cast(k).alias(c) for c, k in (("t", "binary"), ("w", "binary"), ("samples", "array<binary>"))]
    state, backs, totals = counts.select("*", *none), [], []
    for number in range(BURN_IN + SAMPLES):
        shared, old = context.broadcast(levels), state
        step = lambda it, k=number, s=shared: _round(it, s.value, k, k >= BURN_IN)
        state = kept(old.select(*(x.split(" ")[0] for x in COUNTS.split(", ")), "t", "w", "samples").mapInArrow(step, STATE), "seating")
        levels.tables = context_sums(state.select("shard", F.inline("ranges")), last, 1, n)[0]
        levels.seated, levels.parent_tables = (x or 0 for x in state.agg(F.sum("seated"), F.sum("parent_tables")).first())
        if number:
            dropped(old)
        if number >= BURN_IN:
            backs.append(levels.back())
            totals.append((levels.seated, levels.parent_tables))
    return state, backs, totals


def _reply(asked: pd.DataFrame, model: pd.DataFrame, levels: Levels, backs: list[np.ndarray], totals: list[tuple[int, int]], n: int) -> pd.DataFrame:
    words, code, c, mean = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    single = [np.zeros(0)] * SAMPLES
    if len(model):
        r = model.iloc[0]
        words, of, context, c = opened(r)
        code, mean = of * n + context, np.ones(len(c))
        samples = [unsqueeze(x).astype(np.int64) for x in r["samples"]]
        mean[c > 1] = np.mean(samples[0::3], 0)
        single = list(zip(samples[1::3], samples[2::3]))
    count = np.bincount(code // n, c, len(words)).astype(np.int64)
    probs = []
    for k, (seated, tables) in enumerate(totals):
        levels.seated, levels.parent_tables = seated, tables
        m, w = (np.append(x, 0) for x in single[k]) if len(words) else (np.zeros(1), np.zeros(1))
        probs.append(levels.single(m, w))  # the last is an unknown word's
    out = []
    for block, at, pair, of, context in looked_up_pairs(asked, words, code, n):
        known = pair >= 0
        value = np.zeros(len(pair))
        value[known] = (c[pair[known]] - levels.own * mean[pair[known]]) / (STRENGTH + levels.customers[context[known]])
        for back, p in zip(backs, probs):
            value += back[context] * p[at[of]] / len(backs)
        counts = np.where(at >= 0, count[at], 0) if len(count) else np.zeros(len(at), np.int64)
        out.append((block, int(asked["shard"].iloc[0]), squeeze(counts), np.log10(value).astype(np.float32).tobytes()))
    return pd.DataFrame(out, columns=["block", "shard", "words", "pairs"])


def _score(b, replies: pd.DataFrame, tokens: int, types: int, n_contexts: int) -> pd.DataFrame:
    n, place, _, text, _, pair, ids = opened_block(b, n_contexts)
    count = np.concatenate([unsqueeze(x) for x in replies["words"]]).astype(float)[place]
    log = np.concatenate([np.frombuffer(x, np.float32) for x in replies["pairs"]]).astype(float)[pair]
    base = np.log10((count + 0.5) / (tokens + 0.5 * (types + 1)))
    sums = [np.bincount(text, x, len(n)) for x in (base, log, count > 0)]
    return pd.DataFrame({"doc_id": ids, "n_tokens": n + 1, "n_known": sums[2].astype(np.int64), "base_score": sums[0], "score": sums[1]})


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 1. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def score_texts(docs: DataFrame, train: Column) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of docs (doc_id, text).

    A text's tokens are its words and one end; null text counts as empty, with the end alone. train: whether
    a row is learned from. base_score and score are sums of log10 probabilities, of the add-half single-word model and of
    the Pitman-Yor model. Without training rows both are uniform. doc_id must be an integer. Other columns are ignored, rows
    given twice come out twice, null ids stay null; no rows in, none out. The same rows give the same scores in any partitions.
    """
    learned = docs.where(train).select("text")
    shards = n_shards(learned)
    contexts, tokens = contexts_of(learned, shards)
    n = contexts.n
    counts = pair_counts(learned, contexts, shards)
    customers, *seen = context_stats(counts, n)
    words = word_stats(counts)
    levels = Levels(customers, sum(seen), discount(seen[0].sum(), seen[1].sum()), discount(words["k1"], words["k2"]), words["types"])
    model, backs, totals = sampled(counts, levels, n)
    shared = docs.sparkSession.sparkContext.broadcast((levels, backs))  # arrays over contexts
    types = words["types"]
    rows = replied(
        docs.select("doc_id", F.lit(None).alias("label"), "text"), contexts, shards, model.select(*(x.split(" ")[0] for x in COUNTS.split(", ")), "samples"),
        lambda asked, own: _reply(asked, own, *shared.value, totals, n),
        lambda b, own: _score(b, own, tokens, types, n),
        "doc_id long, n_tokens long, n_known long, base_score double, score double",
    )
    return rows.select("doc_id", "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), "base_score", "score")
