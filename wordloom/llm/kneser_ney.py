"""Quality by perplexity: an interpolated modified Kneser-Ney bigram model of trusted text.

Every word of the trusted text has counts of its own. Pairs are counted and looked up over shards of words (token_blocks): each block of
documents asks the shards for the pairs it has, and their counts come back, with each word's share of all (context, word) pairs, the lower
order. What remains per context, its tokens and interpolation weight, are arrays of bounded length. An unknown word
has the lower order's uniform part alone. One trusted row in CALIBRATION is not learned from: the quantiles of these
rows' perplexities, by language, are the thresholds, as the model finds text it has learned too likely.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kept, looked_up
from .token_blocks import context_stats, contexts_of, looked_up_pairs, n_shards, opened, opened_block, pair_counts, replied, squeeze, unsqueeze, word_stats

QUANTILE = 0.99
CALIBRATION = 4
ACCURACY = 10_000  # of the quantile: the rank is off by a ten-thousandth of the rows at most


def discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """Discounts for counts 0, 1, 2 and 3 or more, from the numbers of types seen once to four times."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d1 = 1 - 2 * y * n2 / n1 if n1 else 0.5
    d2 = 2 - 3 * y * n3 / n2 if n2 and n3 else 1.0
    d3 = 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5
    return np.array([0.0, min(max(d1, 0.01), 0.99), min(max(d2, 0.01), 1.99), min(max(d3, 0.01), 2.99)])


class Model:
    """What a block needs besides the counts of its pairs and the contexts of its words."""

    def __init__(self, stats: np.ndarray, words: dict[str, int]):
        total, *seen = stats
        self.total = total
        self.d = discounts(*(s.sum() for s in seen[:4]))
        taken = self.d[1] * seen[0] + self.d[2] * seen[1] + self.d[3] * (seen[2] + seen[3] + seen[4])
        self.back = np.where(total > 0, taken / np.maximum(total, 1), 1.0)
        self.lower_d = discounts(words["k1"], words["k2"], words["k3"], words["k4"])
        self.fans, self.types = words["fans"], words["types"]
        more = self.types - words["k1"] - words["k2"]
        taken = self.lower_d[1] * words["k1"] + self.lower_d[2] * words["k2"] + self.lower_d[3] * more
        self.uniform = (taken / self.fans if self.fans else 1.0) / (self.types + 1)

    def lower(self, contexts: np.ndarray) -> np.ndarray:
        """The lower order: modified Kneser-Ney over a word's number of contexts, interpolated with uniform over all words and one unknown."""
        return np.maximum(contexts - self.lower_d[np.minimum(contexts, 3)], 0) / max(self.fans, 1) + self.uniform

    def log10(self, count: np.ndarray, context: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """Of pairs with these counts and contexts, whose words stand in so many contexts."""
        own = np.maximum(count - self.d[np.minimum(count, 3)], 0) / np.maximum(self.total[context], 1)
        return np.log10(own + self.back[context] * self.lower(contexts))


def _reply(asked: pd.DataFrame, model: pd.DataFrame, n: int) -> pd.DataFrame:
    words, code, c, fan = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(model):
        words, of, context, c = opened(model.iloc[0])
        code, fan = of * n + context, np.bincount(of, minlength=len(words))
    fan, c = np.append(fan, 0), np.append(c, 0)  # the last is for what isn't there
    out = [(block, int(asked["shard"].iloc[0]), squeeze(fan[at]), squeeze(c[pair])) for block, at, pair, _, _ in looked_up_pairs(asked, words, code, n)]
    return pd.DataFrame(out, columns=["block", "shard", "words", "pairs"])


def _score(b, replies: pd.DataFrame, m: Model, n_contexts: int) -> pd.DataFrame:
    n, _, _, text, code, pair, ids = opened_block(b, n_contexts)
    fan = np.concatenate([unsqueeze(x) for x in replies["words"]]).astype(np.int64)
    count = np.concatenate([unsqueeze(x) for x in replies["pairs"]]).astype(np.int64)
    log = m.log10(count, code % n_contexts, fan[code // n_contexts])[pair]
    return pd.DataFrame({"doc_id": ids, "lang": list(b.labels), "n_tokens": n + 1, "log10_prob": np.bincount(text, log, len(n))})


def perplexities(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(doc_id, lang, n_tokens, log10_prob, perplexity) for every row of docs (doc_id, lang, text), by a model of the texts of trusted (text)."""
    shards = n_shards(trusted)
    contexts, _ = contexts_of(trusted, shards)
    n = contexts.n
    counts = pair_counts(trusted, contexts, shards)
    shared = docs.sparkSession.sparkContext.broadcast(Model(context_stats(counts, n), word_stats(counts)))  # arrays over contexts
    scored = replied(
        docs.select("doc_id", F.col("lang").alias("label"), "text"), contexts, shards, counts, lambda asked, own: _reply(asked, own, n), lambda b, own: _score(b, own, shared.value, n),
        "doc_id long, lang string, n_tokens long, log10_prob double",
    )
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("log10_prob") / F.col("n_tokens")))


def quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, trusted, n_tokens, log10_prob, perplexity, threshold, keep) for every row of docs (doc_id, lang, text).

    Trusted are rows whose doc_id has quality 1 in labels (doc_id, quality) and none of 0. threshold: the
    quantile of the calibration rows' perplexities in the row's language (null is one), or of all calibration rows where
    it has none; null, and all kept, without any. keep: perplexity within the threshold. Null text counts as empty: an
    end alone. Ties with the threshold are kept. doc_id must be an integer; null ids are never trusted. Other columns are ignored, rows
    given twice come out twice; no rows in, none out.
    """
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    good = looked_up(good.select(F.col("doc_id").alias("good")), "good")
    calibrates = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(CALIBRATION)) == 0
    trusted = docs.where(~calibrates).join(good, F.col("doc_id") == F.col("good"), "left_semi").select("text")
    scored = kept(perplexities(docs, trusted), "perplexities")
    scored = kept(scored.join(good, F.col("doc_id") == F.col("good"), "left").withColumn("trusted", F.col("good").isNotNull()).drop("good"), "labelled")
    held = scored.where(F.col("trusted") & calibrates)
    at = F.percentile_approx("perplexity", F.lit(quantile), F.lit(ACCURACY)).alias("threshold")
    every = held.agg(at).first()[0]
    by_lang = held.groupBy(F.col("lang").alias("of")).agg(at)
    joined = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("of")), "left").withColumn("threshold", F.coalesce("threshold", F.lit(every).cast("double")))
    keep = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return joined.select("doc_id", "lang", "trusted", "n_tokens", "log10_prob", "perplexity", "threshold", keep.alias("keep"))
