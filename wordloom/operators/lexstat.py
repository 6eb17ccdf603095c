"""Cognate detection in the manner of the published LexStat method (S7, S10): CL-4 to CL-7.

A word is a row of segments, each typed by its place: a vowel, or a consonant at the beginning, inside or at the end. For each pair
of languages, aligned segments of words of the same concept are counted and compared with what random pairs of words give; log-odds, mixed
with a score of sound classes, give distances of words, and average linkage within a concept gives sets.
Words that are spelt alike are aligned once, whatever languages and concepts they are in, and random pairs are as many for two languages as one says,
so that training grows with the pairs of words of a concept alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import dropped, kept
from .linkage import NEAR, SCALE, MergeTree, merge_sums, pair_index
from .numbering import numbered

# Sound classes, each with the letters that have it.
SOUND_CLASSES = {
    "V": "aeiouyæɑɨʉɯəɛɔʊɪãẽĩõũéèêíóöäü", "P": "pbɓ", "T": "tdɗθð", "K": "kgqɡcxç", "S": "szʃʒjʧʤ", "M": "m", "N": "nŋɲñ", "L": "lrɾʁ", "W": "wvfɸβ", "H": "hɦʔ",
}
_CLASS = {s: c for c, letters in SOUND_CLASSES.items() for s in letters}
GAP = -1.0
CUT = 0.7  # words nearer than this by sound class are counted as attested
MIX = 0.6  # share of log-odds in a score
DRAWS = 10_000  # random pairs of words that expected counts of two languages come from, about


def sound_class(segment: str) -> str:
    return _CLASS.get(segment[:1].lower(), "0")


def typed(tokens: list[str]) -> list[str]:
    """Segments with their place: / and V for a vowel, else ^ at the beginning, $ at the end, - inside."""
    last = len(tokens) - 1
    return [f"{t}/{'V' if sound_class(t) == 'V' else '^' if k == 0 else '$' if k == last else '-'}" for k, t in enumerate(tokens)]


def align(a: list[str], b: list[str], score) -> tuple[float, list[tuple[str, str]]]:
    """(score, aligned pairs without gaps) of a global alignment."""
    n, m = len(a), len(b)
    s = np.zeros((n + 1, m + 1))
    s[:, 0], s[0, :] = GAP * np.arange(n + 1), GAP * np.arange(m + 1)
    for i in range(n):
        for j in range(m):
            s[i + 1, j + 1] = max(s[i, j] + score(a[i], b[j]), s[i, j + 1] + GAP, s[i + 1, j] + GAP)
    pairs, i, j = [], n, m
    while i and j:
        if s[i, j] == s[i - 1, j - 1] + score(a[i - 1], b[j - 1]):
            i, j = i - 1, j - 1
            pairs.append((a[i], b[j]))
        elif s[i, j] == s[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return float(s[n, m]), pairs[::-1]


def _by_class(x: str, y: str) -> float:
    """Score of two typed segments by what they are; their places don't count."""
    x, y = x.rsplit("/", 1)[0], y.rsplit("/", 1)[0]
    if x == y:
        return 1.0
    return 0.5 if sound_class(x) == sound_class(y) else -0.5 if "V" not in (sound_class(x), sound_class(y)) else -1.0


def _distance(a: list[str], b: list[str], score) -> tuple[float, list[tuple[str, str]]]:
    own, pairs = align(a, b, score)
    most = sum(score(x, x) for x in a) + sum(score(x, x) for x in b)
    return (min(1.0, max(0.0, 1 - 2 * own / most)) if most > 0 else float(a != b)), pairs


def _padded(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(w) for w in words], np.int64)
    out = np.zeros((len(words), n.max(initial=0)), np.int64)
    for k, w in enumerate(words):
        out[k, : len(w)] = w
    return out, n


def _filled(words: list[np.ndarray], a: np.ndarray, b: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, ...]:
    padded, size = _padded(words)
    left, right, n, m = padded[a], padded[b], size[a], size[b]
    rows, cols = n.max(initial=0), m.max(initial=0)
    s = np.zeros((rows + 1, cols + 1, len(a)))
    s[:, 0], s[0] = GAP * np.arange(rows + 1)[:, None], GAP * np.arange(cols + 1)[:, None]
    for i in range(rows):
        for j in range(cols):
            s[i + 1, j + 1] = np.maximum(np.maximum(s[i, j] + scores[left[:, i], right[:, j]], s[i, j + 1] + GAP), s[i + 1, j] + GAP)
    return s, left, right, n, m


def scores_many(words: list[np.ndarray], a: np.ndarray, b: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """The scores of align_many alone, AT_ONCE pairs at a time."""
    found = [np.zeros(0)]
    for k in range(0, len(a), AT_ONCE):
        s, _, _, n, m = _filled(words, a[k : k + AT_ONCE], b[k : k + AT_ONCE], scores)
        found.append(s[n, m, np.arange(len(n))])
    return np.concatenate(found)


def align_many(words: list[np.ndarray], a: np.ndarray, b: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(scores, pair, x, y) of global alignments of words[a] with words[b], many at once, as align has them one by one.

    Segments are numbers, scores is a table over them; pair, x and y say which segments of which pair are aligned without a gap.
    """
    s, left, right, n, m = _filled(words, a, b, scores)
    found, i, j = s[n, m, np.arange(len(a))], n.copy(), m.copy()
    pair, xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(k := np.flatnonzero((i > 0) & (j > 0))):
        x, y, now = left[k, i[k] - 1], right[k, j[k] - 1], s[i[k], j[k], k]
        both = now == s[i[k] - 1, j[k] - 1, k] + scores[x, y]
        up = ~both & (now == s[i[k] - 1, j[k], k] + GAP)
        pair.append(k[both])
        xs.append(x[both])
        ys.append(y[both])
        i[k] -= both | up
        j[k] -= ~up
    return found, *(np.concatenate(v) for v in (pair, xs, ys))


AT_ONCE = 4096  # pairs of words that are aligned side by side
PART = 65_536  # pairs of words that a group of a pair of languages has, about
JOINED = "\x01"  # between the segments of a word
_LANGS = ["lang_a", "lang_b"]
_KEYS = [*_LANGS, "x", "y"]


class Spelt:
    """The distinct words of two columns of joined segments: their typed segments by number, and each row's words."""

    def __init__(self, left: pd.Series, right: pd.Series):
        code, every = pd.factorize(pd.concat([left, right], ignore_index=True))
        self.a, self.b = code[: len(left)], code[len(left) :]
        typed_ = [typed(w.split(JOINED)) if w else [] for w in every]
        self.segments = sorted({x for w in typed_ for x in w})
        self.place = {x: k for k, x in enumerate(self.segments)}
        self.words = [np.array([self.place[x] for x in w], np.int64) for w in typed_]

    def by_class(self) -> np.ndarray:
        """_by_class of every two segments."""
        bare = pd.factorize(np.array([x.rsplit("/", 1)[0] for x in self.segments], object))[0]
        kind = np.array([sound_class(x) for x in self.segments], object)
        other = np.where((kind[:, None] == "V") | (kind == "V"), -1.0, -0.5)
        return np.where(bare[:, None] == bare, 1.0, np.where(kind[:, None] == kind, 0.5, other))

    def pair_scores(self, counts: pd.DataFrame) -> np.ndarray:
        """pair_score of every two segments, by counts (x, y, attested, expected) where there are some."""
        own = self.by_class()
        x, y = counts["x"].map(self.place), counts["y"].map(self.place)
        known = (x.notna() & y.notna()).to_numpy()
        odds = np.zeros(own.shape)
        at = x[known].to_numpy(int), y[known].to_numpy(int)
        odds[at] = np.log2((counts["attested"].to_numpy(float)[known] + 0.5) / (counts["expected"].to_numpy(float)[known] + 0.5))
        return np.where(own == 1.0, own, MIX * np.clip(odds / 2, -1, 1) + (1 - MIX) * own)

    def distances(self, found: np.ndarray, scores: np.ndarray) -> np.ndarray:
        own = np.array([scores[w, w].sum() for w in self.words])
        most = own[self.a] + own[self.b]
        return np.where(most > 0, np.clip(1 - 2 * found / np.where(most > 0, most, 1), 0, 1), self.a != self.b)


def _aligned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (spelt_a, spelt_b, word_a, word_b) to the aligned segments (x, y) of those words that are nearer than CUT by sound class."""
    for whole in frames:
        for k in range(0, len(whole), AT_ONCE):
            rows = whole.iloc[k : k + AT_ONCE]
            spelt = Spelt(rows["word_a"], rows["word_b"])
            scores = spelt.by_class()
            found, pair, x, y = align_many(spelt.words, spelt.a, spelt.b, scores)
            pair_x_y = pd.DataFrame({"pair": pair, "x": x, "y": y})[(spelt.distances(found, scores) < CUT)[pair]]
            name = np.array(spelt.segments, object)
            of = pair_x_y["pair"].to_numpy()
            yield pd.DataFrame({"spelt_a": rows["spelt_a"].to_numpy()[of], "spelt_b": rows["spelt_b"].to_numpy()[of], "x": name[pair_x_y["x"]], "y": name[pair_x_y["y"]]})


def pair_score(x: str, y: str, attested: float, expected: float) -> float:
    """Of two typed segments: log-odds within bounds, mixed with the score of sound classes; segments that are the same have that alone."""
    own = _by_class(x, y)
    if x.rsplit("/", 1)[0] == y.rsplit("/", 1)[0]:
        return own
    odds = math.log2((attested + 0.5) / (expected + 0.5))
    return MIX * max(-1.0, min(1.0, odds / 2)) + (1 - MIX) * own


def _scored(pairs: pd.DataFrame, counts: pd.DataFrame, own: list[str]) -> pd.DataFrame:
    """The columns own of pairs of two languages with their distances; words that recur are aligned once."""
    if not len(pairs):
        return pairs.assign(distance=[])[[*own, "distance"]]
    spelt = Spelt(pairs["word_a"], pairs["word_b"])
    each, at = np.unique(spelt.a * len(spelt.words) + spelt.b, return_inverse=True)
    spelt.a, spelt.b = each // len(spelt.words), each % len(spelt.words)
    scores = spelt.pair_scores(counts)
    return pairs[own].assign(distance=spelt.distances(scores_many(spelt.words, spelt.a, spelt.b, scores), scores)[at])


DISTANCES = "concept string, lang_a string, form_a string, lang_b string, form_b string, distance double"


def drawn_pairs(pairs: DataFrame, draws: int | None = DRAWS, word: str = "word") -> tuple[DataFrame, DataFrame]:
    """((lang_a, lang_b, word_a, word_b, drawn), (lang_a, lang_b, of, slots)): left and right words of two languages that meet at random.

    The left word of each of the pairs (`of` of them) falls into one of slots by a hash of the pair, and so does its right word by another one; what
    is in one slot meets. There are of squared / draws slots, so that about `draws` words meet: a left and a right word of any two pairs do with probability
    1 / slots, and drawn * slots / of has the mean of random pairings as its own. An expected count e has a standard error of sqrt(e * of / draws), or
    none if there is one slot, as with of squared below draws or with draws None: everything meets then, which is quadratic.
    """
    sizes = pairs.groupBy(*_LANGS).agg(F.count("*").alias("of"))
    slots = F.lit(1).cast("long") if draws is None else F.greatest(F.lit(1).cast("long"), F.floor(F.col("of").cast("double") * F.col("of") / draws))
    sizes = kept(sizes.withColumn("slots", slots), "sizes")

    def dealt(side: str, salt: int) -> DataFrame:
        slot = F.pmod(F.xxhash64("concept", "form_a", "form_b", F.lit(salt)), "slots").alias("slot")
        rows = pairs.join(sizes, _LANGS).select(*_LANGS, slot, f"{word}_{side}").repartition(*_LANGS, "slot")
        return rows.groupBy(*_LANGS, "slot", f"{word}_{side}").agg(F.count("*").alias(f"n_{side}"))

    met = dealt("a", 1).join(dealt("b", 2), [*_LANGS, "slot"])
    return met.groupBy(*_LANGS, f"{word}_a", f"{word}_b").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("drawn")), sizes


def segment_counts(pairs: DataFrame, draws: int | None = DRAWS) -> DataFrame:
    """_counts of pairs (concept, lang_a, form_a, word_a, lang_b, form_b, word_b)."""
    spellings = _spellings(pairs.select(F.explode(F.array("word_a", "word_b")).alias("word")))
    for s in "ab":
        pairs = pairs.join(spellings.select(F.col("word").alias(f"word_{s}"), F.col("spelt").alias(f"spelt_{s}")), f"word_{s}")
    return _counts(pairs, spellings, draws)


def _spellings(words: DataFrame) -> DataFrame:
    """(word, spelt): numbers for the distinct words."""
    return kept(numbered(words.where("word is not null").select("word").distinct(), ["word"], "spelt"), "spellings")


def _counts(pairs: DataFrame, spellings: DataFrame, draws: int | None) -> DataFrame:
    """(lang_a, lang_b, x, y, attested, expected): aligned segments of words of one concept, and how many random pairings would give.

    Two spellings are aligned once for all languages. Counts are whole numbers until the last step, and so the same under any partitioning.
    """
    met, sizes = drawn_pairs(pairs, draws, "spelt")
    zero = F.lit(0).cast("long")
    spelt = ["spelt_a", "spelt_b"]
    own = pairs.groupBy(*_LANGS, *spelt).agg(F.count("*").alias("attested")).withColumn("drawn", zero)
    weights = kept(own.unionByName(met.withColumn("attested", zero)), "weights")
    asked = weights.select(*spelt).distinct()
    for s in "ab":
        asked = asked.join(spellings.select(F.col("spelt").alias(f"spelt_{s}"), F.col("word").alias(f"word_{s}")), f"spelt_{s}")
    aligned = _dealt(asked, *spelt).mapInPandas(_aligned, "spelt_a long, spelt_b long, x string, y string")
    found = weights.join(kept(aligned, "aligned"), spelt)
    found = found.groupBy(*_KEYS).agg(F.sum("attested").alias("attested"), F.sum("drawn").alias("drawn")).join(sizes, _LANGS)
    return found.select(*_KEYS, "attested", (F.col("drawn") * F.col("slots") / F.col("of")).alias("expected"))


def _dealt(df: DataFrame, *by: str) -> DataFrame:
    """df in several partitions a core: few bytes are much work here, by which Spark would not part them."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *by)


_PLACED = "concept string, place_a int, place_b int, lang_a string, lang_b string, form_a string, form_b string"
_MEMBERS = "concept string, member_a int, member_b int"


def _distances(words: DataFrame, draws: int | None, of: str = _PLACED) -> tuple[DataFrame, DataFrame]:
    """(words (concept, lang, form, word, place, member), the distances of word_distances with place_a and place_b, or with the columns of).

    A place is a word's among its concept's words, from 0, by lang and form. Words of a concept that are one form with the same segments in several languages are
    at distance 0 and a single member, numbered by its first place; with _MEMBERS their distances are left out. Segments that several forms have make no member:
    such words of one language are at distance 1.
    """
    own = words.dropDuplicates(["concept", "lang", "form"]).select("concept", "lang", "form", F.array_join("tokens", JOINED).alias("word"))
    place = F.row_number().over(Window.partitionBy("concept").orderBy("lang", "form")) - 1
    alike = Window.partitionBy("concept", "word")
    single = F.col("word").isNotNull() & (F.min("form").over(alike) == F.max("form").over(alike))
    own = own.withColumn("place", place).withColumn("member", F.when(single, F.min("place").over(alike)).otherwise(F.col("place")))
    own = kept(own, "words")
    spellings = _spellings(own)
    known = _dealt(own.join(spellings, "word"), "concept", "lang", "form")
    side = lambda s: known.select("concept", *(F.col(c).alias(f"{c}_{s}") for c in ("lang", "form", "place", "member", "word", "spelt")))
    pairs = kept(side("a").join(side("b"), "concept").where("lang_a < lang_b"), "pairs")
    counts = kept(_counts(pairs.drop("word_a", "word_b"), spellings, draws), "segments")
    parts = kept(pairs.groupBy(*_LANGS).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")), "parts")
    keys, carried = [*_LANGS, "salt"], [c.split()[0] for c in of.split(", ")]
    asked = pairs.where("member_a <> member_b") if of == _MEMBERS else pairs
    dealt = asked.join(parts, _LANGS).withColumn("salt", F.pmod(F.xxhash64("concept", "place_a", "place_b"), "parts").cast("int"))
    dealt = dealt.select(*dict.fromkeys([*carried, *keys, "word_a", "word_b"]))
    each = counts.join(parts, _LANGS).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    n = 4 * words.sparkSession.sparkContext.defaultParallelism
    dealt, each = dealt.repartition(n, *keys), each.repartition(n, *keys)
    return own, dealt.groupBy(*keys).cogroup(each.groupBy(*keys)).applyInPandas(lambda p, c: _scored(p, c, carried), f"{of}, distance double")


def word_distances(words: DataFrame, draws: int | None = DRAWS) -> DataFrame:
    """CL-4: (concept, lang_a, form_a, lang_b, form_b, distance), lang_a < lang_b, of words (concept, lang, form, tokens).

    draws: random pairs of words for two languages, see drawn_pairs; None takes all.
    """
    return _distances(words, draws)[1].select("concept", "lang_a", "form_a", "lang_b", "form_b", "distance")


def _tree(words: pa.Table, distances: pa.Table) -> tuple[pa.Table, MergeTree]:
    """A concept's words (form, place and more) by place, and the tree by their distances (place_a, place_b, distance).

    A word with n stands for n of its form; two of these then have sums (total, n) over n pairs in place of a distance. Pairs without a distance are 1 apart, or 0 if their forms are the same.
    """
    words = words.sort_by("place")
    n, place = words.num_rows, words["place"].to_numpy()
    form = pd.factorize(words["form"].to_numpy())[0]
    weight = words["n"].to_numpy().astype(float) if "n" in words.column_names else np.ones(n)
    total = np.empty(n * (n - 1) // 2)
    for i in range(n - 1):
        at = pair_index(n, i, i + 1)
        total[at : at + n - 1 - i] = SCALE * weight[i] * weight[i + 1 :] * (form[i] != form[i + 1 :])
    for batch in distances.to_batches():
        i, j = (np.searchsorted(place, batch[f"place_{s}"].to_numpy()) for s in "ab")
        found, of = (batch["total"].to_numpy(), batch["n"].to_numpy()) if "total" in batch.schema.names else (np.rint(batch["distance"].to_numpy() * SCALE), 1)
        total[pair_index(n, np.minimum(i, j), np.maximum(i, j))] += found - SCALE * (form[i] != form[j]) * of
    return words, merge_sums(total, weight)


def _sets(words: pa.Table, distances: pa.Table, thresholds: tuple[float, ...]) -> pa.Table:
    """A concept's words and distances, as _tree has them, to its sets at each threshold: one tree, cut as often as asked."""
    words, tree = _tree(words, distances)
    own = words.drop_columns([c for c in ("n",) if c in words.column_names])
    return pa.concat_tables(own.add_column(0, "threshold", pa.array(np.full(len(own), t))).append_column("local", pa.array(tree.labels(t).astype(np.int64))) for t in thresholds)


def _merges(words: pa.Table, distances: pa.Table) -> pa.Table:
    """A concept's words and distances, as _tree has them, to the tree itself: (concept, place, into, height)."""
    words, tree = _tree(words, distances)
    place, joined = words["place"].to_numpy(), np.isfinite(tree.height)
    return pa.table({"concept": words["concept"].filter(pa.array(joined)), "place": place[joined], "into": place[tree.into[joined]], "height": tree.height[joined]})


def _cut(rows: pa.Table, thresholds: tuple[float, ...]) -> pa.Table:
    """A concept's members with what each joins (concept, place, into, height) to its sets at each threshold. No distance is above 1."""
    rows = rows.sort_by("place")
    tree = MergeTree(np.searchsorted(rows["place"].to_numpy(), rows["into"].to_numpy()), rows["height"].to_numpy())
    own = rows.select(["concept", "place"])
    local = lambda t: tree.labels(t).astype(np.int64) if t + NEAR < 1 else np.zeros(len(own), np.int64)
    return pa.concat_tables(own.add_column(0, "threshold", pa.array(np.full(len(own), t))).append_column("local", pa.array(local(t))) for t in thresholds)


def _joined(members: DataFrame, sums: DataFrame, top: float) -> DataFrame:
    """(concept, place, into, height): what members join up to the height top, the tree of _tree, by rounds over the cluster until a concept has MEMBERS clusters.

    In a round each two clusters that are nearest to each other are joined, of equally near ones those with the smallest first members. That joins no others than
    one at a time would, as a cluster is no nearer to two that are joined than to one of them. A cluster that has nothing up to top will have nothing later, and goes.
    What is kept of two clusters is how much less than 1 their pairs' distances sum up to; those with nothing less have no row.
    """
    pair = ["concept", "place_a", "place_b"]
    end = lambda s, *more: members.select("concept", F.col("place").alias(f"place_{s}"), F.col("n").alias(f"w_{s}"), *more)
    pairs = F.col("w_a") * F.col("w_b")
    alike = end("a", "form").join(end("b", "form"), ["concept", "form"]).where("place_a < place_b").join(sums, pair, "left")
    alike = alike.select(*pair, ((pairs - F.coalesce("n", F.lit(0))) * SCALE).alias("near"))
    near = sums.select(*pair, (F.col("n") * SCALE - F.col("total")).alias("near")).unionByName(alike).groupBy(*pair).agg(F.sum("near").alias("near"))
    near = kept(near.where("near > 0").join(end("a"), ["concept", "place_a"]).join(end("b"), ["concept", "place_b"]), "near")
    mean = (pairs * SCALE - F.col("near")).cast("double") / pairs
    merges = []
    while True:
        way = lambda x, y: F.struct(F.col(f"place_{x}").alias("x"), F.col(f"w_{x}").alias("w"), mean.alias("mean"), F.col(f"place_{y}").alias("y"))
        ways = near.where(mean <= top * SCALE).select("concept", F.inline(F.array(way("a", "b"), way("b", "a"))))
        live = kept(ways.groupBy("concept", "x").agg(F.max("w").alias("w"), F.min(F.struct("mean", "y")).alias("to")), "live")
        if live.groupBy("concept").count().where(F.col("count") > MEMBERS).isEmpty():
            break
        other = live.select("concept", F.col("x").alias("y"), F.col("w").alias("w_y"), F.col("to.y").alias("back"))
        now = live.select("concept", "x", "w", "to.mean", "to.y").join(other, ["concept", "y"])
        both = F.col("back") == F.col("x")
        now = kept(now.select("concept", "x", F.when(both, F.least("x", "y")).otherwise(F.col("x")).alias("into"), F.when(both, F.col("w") + F.col("w_y")).otherwise(F.col("w")).alias("w"), "mean"), "clusters")
        merges.append(now.where("into <> x").select("concept", F.col("x").alias("place"), "into", (F.col("mean") / SCALE).alias("height")))
        at = lambda s: now.select("concept", F.col("x").alias(f"place_{s}"), F.struct(F.col("into").alias("place"), "w").alias(s))
        step = near.select(*pair, "near").join(at("a"), ["concept", "place_a"]).join(at("b"), ["concept", "place_b"]).where("a.place <> b.place")
        step = step.groupBy("concept", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("near").alias("near"))
        step = kept(step.select("concept", *(F.col(f"{s}.{c}").alias(f"{name}_{s}") for s in "ab" for c, name in (("place", "place"), ("w", "w"))), "near"), "near")
        dropped(near)
        near = step
    rest = live.select("concept", F.col("x").alias("place"), F.col("x").cast("string").alias("form"), F.col("w").alias("n"))
    for s in "ab":
        near = near.join(live.select("concept", F.col("x").alias(f"place_{s}")), ["concept", f"place_{s}"], "left_semi")
    less = near.select(*pair, (-F.col("near")).alias("total"), F.lit(0).cast("long").alias("n"))
    merges.append(rest.groupBy("concept").cogroup(less.groupBy("concept")).applyInArrow(_merges, "concept string, place int, into int, height double"))
    return reduce(DataFrame.unionByName, merges)


MEMBERS = 2000  # of a concept whose sets are made in one group


def cognate_sets(words: DataFrame, thresholds: tuple[float, ...] = (0.50, 0.55, 0.60), draws: int | None = DRAWS) -> DataFrame:
    """CL-5, CL-6: (threshold, concept, lang, form, local): sets within each concept, for all thresholds from one training and one tree.

    A set's id over all concepts is (concept, local); one group is a concept's members, which are its distinct forms however many languages have them, and
    whose square it takes in memory, as numbers alone. Distances of words are summed up for two members before they come to a group. A concept of more
    than MEMBERS members is joined by rounds over the cluster until as many clusters are left, so that no group takes more than the square of MEMBERS.
    """
    own, distances = _distances(words.where("concept is not null and lang is not null and form is not null"), draws, _MEMBERS)
    members = own.groupBy("concept", F.col("member").alias("place")).agg(F.first("form").alias("form"), F.count("*").alias("n"))
    two = [F.least("member_a", "member_b").alias("place_a"), F.greatest("member_a", "member_b").alias("place_b")]
    sums = distances.groupBy("concept", *two).agg(F.sum(F.rint(F.col("distance") * SCALE).cast("long")).alias("total"), F.count("*").alias("n"))
    large = members.groupBy("concept").count().where(F.col("count") > MEMBERS).select("concept")
    if whole := large.isEmpty():
        few, near = members, sums
    else:
        large, sums = kept(large, "large"), kept(sums, "sums")
        few, near = (df.join(large, "concept", "left_anti") for df in (members, sums))
    found = few.groupBy("concept").cogroup(near.groupBy("concept")).applyInArrow(lambda w, d: _sets(w, d, thresholds), "threshold double, concept string, place int, form string, local long")
    found = found.drop("form")
    if not whole:
        many, near = (kept(df.join(large, "concept", "left_semi"), name) for df, name in ((members, "members"), (sums, "sums")))
        top = max((t + NEAR for t in thresholds if t + NEAR < 1), default=0.0)
        tree = many.join(_joined(many, near, top), ["concept", "place"], "left").select("concept", "place", F.coalesce("into", "place").alias("into"), F.coalesce("height", F.lit(math.inf)).alias("height"))
        found = found.unionByName(tree.groupBy("concept").applyInArrow(lambda rows: _cut(rows, thresholds), "threshold double, concept string, place int, local long"))
    return own.join(found.withColumnRenamed("place", "member"), ["concept", "member"]).select("threshold", "concept", "lang", "form", "local")


def sweep_summary(sets: DataFrame) -> DataFrame:
    """AG-8, D16: (threshold, n_sets, singletons, singleton_pct, avg_size, max_size), texts formatted as one prints them."""
    sizes = sets.groupBy("threshold", "concept", "local").agg(F.count("*").alias("n"))
    single = F.count_if(F.col("n") == 1)
    return sizes.groupBy("threshold").agg(
        F.count("*").alias("n_sets"), single.alias("singletons"), F.format_string("%.1f%%", 100.0 * single / F.count("*")).alias("singleton_pct"),
        F.format_string("%.2f", F.avg("n")).alias("avg_size"), F.max("n").alias("max_size"),
    )


def with_set_ids(sets: DataFrame) -> DataFrame:
    """sets with cogid, unique over concepts: the place of (concept, local) among the sets of a threshold."""
    sets = kept(sets, "sets")
    ids = numbered(sets.select("threshold", "concept", "local").distinct(), ["concept", "local"], "cogid", within="threshold")
    return sets.join(ids, ["threshold", "concept", "local"]).select("threshold", "concept", "lang", "form", "local", "cogid")
