"""Concepts to a scored reference list of meanings: exact and fuzzy matches, review, partition (S3, S3b, S4).

Neither list is taken to be small: fuzzy matches are joins on parts that the two strings must have in common, and containment is looked for by automata over blocks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as T
from ..functions.unicode import sequence_ratio_to
from ..sources.shared import kept
from .numbering import numbered
from .patterns import first_pattern_in, first_text_with

BLOCK = 500  # expressions of reviewers that one pass over the meanings takes along


def distinct_concepts(rows: DataFrame) -> DataFrame:
    """JO-1, SE-1: (concept, concept_id, row_idx): each concept with its first row's id."""
    return rows.where("concept is not null").groupBy("concept").agg(F.min_by("concept_id", "row_idx").alias("concept_id"), F.min("row_idx").alias("row_idx"))


def with_variants(concepts: DataFrame) -> DataFrame:
    """(concept, ord, variant): spellings of each concept, in order."""
    return concepts.select("concept", F.posexplode(T.variants(F.col("concept"))).alias("ord", "variant"))


_MATCH = ["concept", "concept_id", "row_idx", "id", "name", "score", "match_score", "method"]


def exact_match(concepts: DataFrame, meanings: DataFrame) -> DataFrame:
    """JO-2: matches of concepts (concept, concept_id, row_idx) to meanings (id, name, score) by a variant.

    The first variant that some meaning has, and the first meaning by id that has it, count (Q-5).
    """
    keyed = meanings.where("name is not null").select(T.strip(F.lower("name")).alias("variant"), "id", "name", "score")
    hits = with_variants(concepts).join(keyed, "variant")
    best = hits.groupBy("concept").agg(F.min_by(F.struct("id", "name", "score"), F.struct("ord", "id")).alias("m"))
    rows = concepts.join(best, "concept")
    return rows.select("concept", "concept_id", "row_idx", "m.id", "m.name", "m.score", F.lit(1.0).alias("match_score"), F.lit("exact").alias("method"))


def _letters(c: Column) -> Column:
    """The letters of a string in lower case, each numbered among its equals: two strings have as many in common as letters can be matched at most."""
    letters = F.split(F.lower(c), "")
    return F.transform(letters, lambda x, i: F.concat(x, F.size(F.filter(F.slice(letters, 1, i + 1), lambda y: y == x)).cast("string")))


def _other_lengths(n: Column, threshold: float) -> Column:
    """The lengths that a string may have whose ratio with one of n letters reaches the threshold."""
    return F.sequence(F.ceil(n * (threshold / (2 - threshold)) - 1e-9), F.floor(n * ((2 - threshold) / threshold) + 1e-9))


def _part(n: Column, k: Column, i: Column) -> tuple[Column, Column]:
    """(start, length) of part i of the k + 1 that a string of n letters is cut into."""
    start = F.floor(i * n / (k + 1))
    return start, F.floor((i + 1) * n / (k + 1)) - start


def _spare(threshold: float) -> Column:
    """The most letters that two strings of n and m letters leave unmatched, both counted."""
    return F.floor((1 - threshold) * (F.col("n") + F.col("m")) + 1e-9)


def fuzzy_candidates(variants: DataFrame, names: DataFrame, threshold: float) -> DataFrame:
    """(variant, name): distinct pairs of variants (text) and names (text) that may reach the ratio; none that does is left out.

    Letters that a ratio counts as matched stand in the same order in both strings, so at most k letters are in only one of them, k following from the
    lengths. Of a name's k + 1 parts one is then in the variant as a whole, shifted by no more than the letters that are extra before it: an equality of
    (lengths, number of the part, its letters). Pairs also have enough letters in common, each counted as often as it stands.
    """
    n, m = F.col("n"), F.col("m")
    parts = F.explode(F.sequence(F.lit(0).cast("long"), _spare(threshold))).alias("i")
    own = names.select("text", F.lower("text").alias("s"), F.length(F.lower("text")).cast("long").alias("n")).where("n > 0")
    own = own.withColumn("m", F.explode(_other_lengths(n, threshold))).where("m > 0").select("*", parts)
    start, size = _part(n, _spare(threshold), F.col("i"))
    own = own.select(F.col("text").alias("name"), "n", "m", "i", F.substring(F.col("s"), (start + 1).cast("int"), size.cast("int")).alias("part"))
    asked = variants.select("text", F.lower("text").alias("s"), F.length(F.lower("text")).cast("long").alias("m")).where("m > 0")
    asked = asked.withColumn("n", F.explode(_other_lengths(m, threshold))).where("n > 0").withColumn("k", _spare(threshold)).select("*", parts)
    start, size = _part(n, F.col("k"), F.col("i"))
    asked = asked.withColumns({"start": start, "size": size})
    lowest = F.greatest(F.lit(0), F.col("start") - F.floor((F.col("k") - (m - n)) / 2))
    highest = F.least(m - F.col("size"), F.col("start") + F.floor((F.col("k") + (m - n)) / 2))
    spots = F.when(highest >= lowest, F.sequence(lowest, F.greatest(lowest, highest))).otherwise(F.array().cast("array<bigint>"))
    there = F.array_distinct(F.transform(spots, lambda p: F.substring(F.col("s"), (p + 1).cast("int"), F.col("size").cast("int"))))
    asked = asked.select(F.col("text").alias("variant"), "n", "m", "i", F.explode(there).alias("part"))
    near = asked.join(own, ["n", "m", "i", "part"]).select("variant", "name").distinct()
    common = F.size(F.array_intersect(_letters(F.col("variant")), _letters(F.col("name"))))
    return near.where(2 * common >= (threshold - 1e-9) * (F.length(F.lower("variant")) + F.length(F.lower("name"))))


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """sequence_ratio of each a with its b; what is known of a b serves all of its rows in a batch."""
    out = pd.Series(0.0, a.index)
    for name, variants in a.groupby(b, sort=False):
        ratio = sequence_ratio_to(name)
        out[variants.index] = variants.map(ratio)
    return out


def fuzzy_match(concepts: DataFrame, meanings: DataFrame, threshold: float = 0.8) -> DataFrame:
    """JO-3: the best meaning by sequence ratio for each concept, if it reaches the threshold; the first variant, then meaning, of equal ratios.

    Distinct variants and names meet where fuzzy_candidates has them; each pair is compared once, whatever concepts it is for. A threshold of 0 or
    less, which every pair reaches, is an error.
    """
    if threshold <= 0:
        raise ValueError("threshold must be above 0")
    asked = kept(with_variants(concepts).withColumnRenamed("variant", "text"), "variants")
    names = kept(meanings.where("name is not null").groupBy("name").agg(F.min(F.struct("id", "score")).alias("m")).select(F.col("name").alias("text"), "m.id", "m.score"), "names")
    near = fuzzy_candidates(asked.select("text").distinct(), names, threshold)
    hits = kept(near.withColumn("match_score", _ratio("variant", "name")).where(F.col("match_score") >= threshold), "hits")
    found = asked.join(hits, asked.text == hits.variant).select("concept", "ord", "name", "match_score").join(names.withColumnRenamed("text", "name"), "name")
    best = found.groupBy("concept").agg(F.min_by(F.struct("id", "name", "score", "match_score"), F.struct(-F.col("match_score"), F.col("ord"), F.col("id"))).alias("m"))
    rows = concepts.join(best, "concept")
    return rows.select("concept", "concept_id", "row_idx", "m.id", "m.name", "m.score", "m.match_score", F.lit("fuzzy").alias("method"))


def match_concepts(rows: DataFrame, meanings: DataFrame, threshold: float = 0.8) -> DataFrame:
    """S3: a row for each distinct concept: exact, else fuzzy, else no_match with nulls."""
    concepts = distinct_concepts(rows)
    exact = exact_match(concepts, meanings)
    left = concepts.join(exact.select("concept"), "concept", "left_anti")
    fuzzy = fuzzy_match(left, meanings, threshold)
    none = left.join(fuzzy.select("concept"), "concept", "left_anti")
    nulls = [F.lit(None).cast(t).alias(c) for c, t in (("id", "long"), ("name", "string"), ("score", "double"))]
    none = none.select("concept", "concept_id", "row_idx", *nulls, F.lit(0.0).alias("match_score"), F.lit("no_match").alias("method"))
    return exact.select(_MATCH).unionByName(fuzzy.select(_MATCH)).unionByName(none)


def match_summary(matches: DataFrame) -> DataFrame:
    """AG-6, FI-6: counts by method; percentages are null without concepts (Q-16)."""
    share = lambda n: F.round(F.try_divide(100.0 * n, F.count("*")), 6)
    exact, fuzzy = F.count_if(F.col("method") == "exact"), F.count_if(F.col("method") == "fuzzy")
    return matches.agg(
        F.count("*").alias("total"), exact.alias("n_exact"), fuzzy.alias("n_fuzzy"), (F.count("*") - exact - fuzzy).alias("n_unmatched"),
        F.count_if(F.col("score").isNotNull()).alias("n_scored"), share(exact).alias("pct_exact"), share(exact + fuzzy).alias("pct_matched"),
    )


def _found(queries: DataFrame, meanings: DataFrame) -> DataFrame:
    """FI-8, FI-9, LI-2: (query, nth, id, name, score): the meanings that each of queries (query) finds, numbered by id.

    A query of digits is an id; another is a regular expression looked for in names in any case. Distinct expressions go along in blocks, each a pass
    over the meanings.
    """
    named = meanings.where("name is not null").select("id", "name", "score")
    digits = F.translate("query", ".-", "").rlike(r"^[0-9]+$")
    hits = queries.where(digits).join(named.withColumn("query", F.col("id").cast("string")), "query").select("query", "id", "name", "score")
    patterns = kept(queries.where(~digits), "patterns")
    blocks = -(-patterns.count() // BLOCK)
    for k in range(blocks):
        own = [r.query for r in patterns.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == k).collect()]  # about BLOCK
        if own:
            finds = F.filter(F.array(*map(F.lit, own)), lambda q: F.rlike(F.col("name"), F.concat(F.lit("(?i)"), q)))
            hits = hits.unionByName(named.select(F.explode(finds).alias("query"), "id", "name", "score"))
    return numbered(hits, ["query", "id"], "nth", within="query")


def apply_review(matches: DataFrame, meanings: DataFrame, decisions: DataFrame) -> DataFrame:
    """RV-1: matches after decisions (row_idx, action, query, selection).

    Only fuzzy and no_match rows before the first row with action q are reviewed. n: no match, the score of the match stays
    (Q-14). s: the selection-th meaning that the query finds, if there is one. Empty: accepts a fuzzy match.
    """
    stop = decisions.where(F.lower("action") == "q").agg(F.min("row_idx").alias("stop"))
    d = decisions.select(F.col("row_idx").alias("at"), F.lower("action").alias("action"), F.lower("query").alias("query"), F.col("selection").cast("long").alias("selection"))
    rows = matches.join(d, F.col("row_idx") == F.col("at"), "left").withColumn("_", F.lit(1)).join(F.broadcast(stop.withColumn("_", F.lit(1))), "_")  # one row
    asked = d.where("action = 's' and query is not null").select("query").distinct()
    found = _found(asked, meanings).select(F.col("query").alias("found_by"), F.col("nth"), F.struct("id", "name", "score").alias("hit"))
    rows = rows.join(found, (F.col("query") == F.col("found_by")) & (F.col("selection") == F.col("nth")), "left")
    open_ = F.col("method").isin("fuzzy", "no_match") & F.col("at").isNotNull() & (F.col("stop").isNull() | (F.col("row_idx") < F.col("stop")))
    picked = F.when(open_ & (F.col("action") == "s"), F.col("hit"))
    rows = rows.withColumns({"open": open_, "picked": picked})
    no, took = F.col("open") & (F.col("action") == "n"), F.col("picked").isNotNull()
    value = lambda c: F.when(no, None).when(took, F.col(f"picked.{c}")).otherwise(F.col(c)).alias(c)
    accepted = F.col("open") & (F.col("action") == "") & (F.col("method") == "fuzzy")
    method = F.when(no, "manual_no_match").when(took, "manual").when(accepted, "fuzzy_accepted").otherwise(F.col("method"))
    return rows.select("concept", "concept_id", "row_idx", value("id"), value("name"), value("score"), F.when(took, 1.0).otherwise(F.col("match_score")).alias("match_score"), method.alias("method"))


def score_keys(matches: DataFrame) -> DataFrame:
    """JO-4, AG-20: (key, score, pos): normalised concepts; of equal keys the last score and the first place."""
    rows = matches.select(T.normalise_b(F.col("concept")).alias("key"), "score", "row_idx").where("key is not null")
    last = rows.groupBy("key").agg(F.max_by(F.struct("score"), "row_idx").alias("s"), F.min("row_idx").alias("pos"))
    return last.select("key", "s.score", "pos")


def containing(keys: DataFrame, others: DataFrame) -> DataFrame:
    """JO-5: (key, pos, score): for each distinct key the first by pos of others (of, pos, score) that contains it or that it contains.

    Automata look for blocks of the ones in the others and keep the first alone, so work follows letters and not matches. The empty string is contained in all.
    """
    keys, others = kept(keys, "keys"), kept(others, "others")
    asked, given = keys.where("key <> ''"), others.where("of <> ''")
    around = first_text_with(asked.select(F.col("key").alias("pattern")), given.select(F.col("of").alias("text"), "pos"))
    inside = first_pattern_in(given.select(F.col("of").alias("pattern"), "pos"), asked.select(F.col("key").alias("text")))
    first = others.agg(F.min("pos").alias("pos")).where("pos is not null")
    blank = others.where("of = ''").agg(F.min("pos").alias("pos")).where("pos is not null")
    every = around.unionByName(inside).unionByName(keys.where("key = ''").join(F.broadcast(first), F.lit(True)).select("key", "pos"))  # one row
    every = every.unionByName(asked.join(F.broadcast(blank), F.lit(True)).select("key", "pos"))  # one row at most
    return every.groupBy("key").agg(F.min("pos").alias("pos")).join(others.select("pos", "score"), "pos").select("key", "pos", "score")


def score_partition(concepts: DataFrame, keys: DataFrame, threshold: float = 0.8) -> DataFrame:
    """S4: (concept, concept_id, row_idx, score, category, new_id) for each concept.

    A concept has the score of its key, even a null one; else of the first key that contains it or that it contains (JO-5, Q-6).
    category: unmatched without score, basic from the threshold on, else borrowable (SE-5). new_id numbers a category's concepts
    in their order (WI-2).
    """
    named = concepts.withColumn("key", T.normalise_b(F.col("concept")))
    exact = named.join(keys.select("key", F.struct("score").alias("hit")), "key", "left")
    left = kept(exact.where("hit is null and key is not null").select("key").distinct(), "keys")
    near = containing(left, keys.select(F.col("key").alias("of"), "pos", "score"))
    near = near.select(F.col("key").alias("by_key"), F.struct(F.col("score").alias("near")).alias("n"))
    scored = exact.join(near, F.col("key") == F.col("by_key"), "left")
    score = F.when(F.col("hit").isNotNull(), F.col("hit.score")).otherwise(F.col("n.near"))
    scored = scored.select("concept", "concept_id", "row_idx", score.alias("score"))
    scored = scored.withColumn("score", F.when(~F.isnan("score"), F.col("score")))
    category = F.when(F.col("score").isNull(), "unmatched").when(F.col("score") >= threshold, "basic").otherwise("borrowable")
    scored = scored.withColumn("category", category)
    return numbered(scored, ["row_idx", "concept"], "new_id", within="category")
