"""Cognate sets: profiles, tone clusters and splits (S8, S9), summaries (S7)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import kept
from .linkage import merge_tree
from .numbering import numbered


def form_counts(words: DataFrame) -> DataFrame:
    """(cogid, form, n): distinct forms of each set; null counts as empty."""
    return words.groupBy("cogid", F.coalesce("form", F.lit("")).alias("form")).agg(F.count("*").alias("n"))


TILE = 256  # distinct forms of a tile, about
TASK_PAIRS = 1 << 22  # pairs that a task compares, about


def pair_blocks(counts: DataFrame) -> DataFrame:
    """(cogid, i, j, a, b): the pairs of distinct forms of each set as blocks, a and b being arrays of (form, n), of form_counts that are kept.

    A set of m forms has ceil(m / TILE) tiles, which forms are dealt to by hash; tile i meets tile j for each i <= j, so a block has about TILE squared
    pairs at most and a key of its own, however large the set. Blocks are dealt to as many tasks as pairs need, one after another, so that tasks have
    equally many.
    """
    sizes = counts.groupBy("cogid").agg(F.count("*").alias("m"))
    pairs = sizes.agg(F.sum(F.col("m").cast("double") * (F.col("m") - 1) / 2)).first()[0] or 0
    tiles = sizes.select("cogid", F.ceil(F.col("m") / TILE).cast("int").alias("tiles"))
    tiles = counts.join(tiles, "cogid").withColumn("tile", F.pmod(F.xxhash64("form"), "tiles").cast("int"))
    tiles = tiles.groupBy("cogid", "tiles", "tile").agg(F.collect_list(F.struct("form", "n")).alias("forms"))
    left = tiles.select("cogid", "tiles", F.col("tile").alias("i"), F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("j"), F.col("forms").alias("a"))
    right = tiles.select("cogid", F.explode(F.sequence(F.lit(0), "tile")).alias("i"), F.col("tile").alias("j"), F.col("forms").alias("b"))
    blocks = left.join(right, ["cogid", "i", "j"])
    if (tasks := int(pairs // TASK_PAIRS) + 1) > 1:
        nth = F.pmod(F.xxhash64("cogid"), F.lit(tasks)) + F.col("i").cast("long") * F.col("tiles") - F.expr("i * (i + 1L) div 2") + F.col("j")  # consecutive in a set
        blocks = blocks.repartitionById(tasks, F.pmod(nth, F.lit(tasks)).cast("int"))
    return blocks.drop("tiles")


def pair_distances(words: DataFrame) -> DataFrame:
    """JO-8, S-16: (cogid, form_a, form_b, n_pairs, distance) of distinct forms in a set, form_a < form_b.

    Members with equal forms have distance 0 and need no pair; n_pairs says how many pairs of members a row stands for.
    """
    blocks = pair_blocks(kept(form_counts(words).where("cogid is not null"), "forms"))
    rows = blocks.select("cogid", "i", "j", F.explode("a").alias("x"), "b").select("cogid", "i", "j", "x", F.explode("b").alias("y"))
    rows = rows.where((F.col("i") < F.col("j")) | (F.col("x.form") < F.col("y.form")))
    first, last = F.least("x.form", "y.form"), F.greatest("x.form", "y.form")
    pairs = rows.select("cogid", first.alias("form_a"), last.alias("form_b"), (F.col("x.n") * F.col("y.n")).alias("n_pairs"))
    return pairs.withColumn("distance", T.edit_distance(F.col("form_a"), F.col("form_b")))


def set_profile(words: DataFrame, size_threshold: int = 8, diversity_threshold: float = 0.6) -> DataFrame:
    """AG-9 to AG-11: a row for each set of words (id, concept, doculect, form, cogid)."""
    sets = words.groupBy("cogid").agg(F.count("*").alias("size"), F.count_distinct("doculect").alias("languages"), F.count_distinct("concept").alias("concepts"))
    spread = pair_distances(words).groupBy("cogid").agg(F.sum(F.col("n_pairs") * F.col("distance")).alias("total"), F.max("distance").alias("most"))
    rows = sets.join(spread, "cogid", "left")
    pairs = F.col("size") * (F.col("size") - 1) / 2
    rows = rows.withColumns({"avg": F.coalesce(F.col("total") / F.when(pairs > 0, pairs), F.lit(0.0)), "most": F.coalesce("most", F.lit(0.0))})
    large, diverse, multi = F.col("size") > size_threshold, F.col("avg") > diversity_threshold, F.col("concepts") > 1
    flags = F.concat_ws(
        "; ",
        F.when(large, F.format_string("large(%d)", "size")),
        F.when(diverse, F.format_string("diverse(%.2f)", "avg")),
        F.when(multi, F.format_string("multi-concept(%d)", "concepts")),
    )
    return rows.select("cogid", "size", "languages", "concepts", F.bround("avg", 3).alias("avg_diversity"), F.bround("most", 3).alias("max_diversity"), (large | diverse | multi).alias("is_unstable"), flags.alias("flags"))


def set_summary(profile: DataFrame, size_threshold: int = 8, diversity_threshold: float = 0.6) -> DataFrame:
    """AG-8, AG-12: one row; diverse counts the rounded average (Q-13)."""
    share = lambda n: F.round(F.try_divide(100.0 * n, F.count("*")), 6)
    single, unstable = F.count_if(F.col("size") == 1), F.count_if(F.col("is_unstable"))
    return profile.agg(
        F.count("*").alias("n_sets"), single.alias("singletons"), share(single).alias("singleton_pct"), F.round(F.avg("size"), 6).alias("avg_size"), F.max("size").alias("max_size"),
        unstable.alias("n_unstable"), share(unstable).alias("unstable_pct"), F.count_if(F.col("size") > size_threshold).alias("n_large"),
        F.count_if(F.col("avg_diversity") > diversity_threshold).alias("n_diverse"), F.count_if(F.col("concepts") > 1).alias("n_multi"),
    )


def unstable_ids(profile: DataFrame) -> DataFrame:
    """FI-7, SO-2: (place, cogid) of unstable sets, the most diverse first; ties by id."""
    rows = profile.where("is_unstable").select("avg_diversity", "cogid")
    return numbered(rows, [F.col("avg_diversity").desc(), F.col("cogid")], "place").select("place", "cogid")


def tone_lookup(tones: DataFrame) -> DataFrame:
    """JO-6, AG-20: (concept, lang, pattern): of the rows (row_idx, concept, lang, pattern) with a pattern the last."""
    return tones.where(T.non_blank(F.col("pattern"))).groupBy("concept", "lang").agg(F.max_by("pattern", "row_idx").alias("pattern"))


def _tone_clusters(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    group = group.sort_values("first", kind="stable")
    tones = group["pattern"].str.split(".")
    size = tones.str.len().to_numpy()
    n = len(group)
    at = np.full((n, size.max()), -1)
    at[np.arange(at.shape[1]) < size[:, None]] = pd.factorize(tones.explode())[0]
    same = [((at[k + 1 :] == at[k]) & (at[k] >= 0)).sum(1) / np.maximum(size[k + 1 :], size[k]) for k in range(n)]
    tree = merge_tree(1 - np.concatenate(same), group["n"].to_numpy())
    return pd.DataFrame({"cogid": group["cogid"], "pattern": group["pattern"], "n": group["n"], "first": group["first"], "cluster": tree.labels(threshold).astype(np.int64)})


def tone_clusters(members: DataFrame, threshold: float = 0.6) -> DataFrame:
    """CL-1: (cogid, pattern, n, first, cluster) from members (id, cogid, pattern). A group is a set's distinct patterns, not its members."""
    patterns = members.where(T.non_blank(F.col("pattern"))).groupBy("cogid", "pattern").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return patterns.groupBy("cogid").applyInPandas(lambda g: _tone_clusters(g, threshold), "cogid long, pattern string, n long, first long, cluster long")


def split_decisions(clusters: DataFrame, sets: DataFrame) -> DataFrame:
    """CL-2, AG-14: (cogid, n_toned, n_clusters, n_large, decision) for each of sets (cogid)."""
    sizes = clusters.groupBy("cogid", "cluster").agg(F.sum("n").alias("n"))
    per = sizes.groupBy("cogid").agg(F.sum("n").alias("n_toned"), F.count("*").alias("n_clusters"), F.count_if(F.col("n") >= 2).alias("n_large"))
    rows = sets.join(per, "cogid", "left").fillna(0, ["n_toned", "n_clusters", "n_large"])
    decision = (
        F.when(F.col("n_toned") < 3, "no_tone_data")
        .when((F.col("n_clusters") <= 1) | (F.col("n_large") == 0), "keep")
        .when(F.col("n_large").between(2, 3), "split")
        .otherwise("review")
    )
    return rows.withColumn("decision", decision)


def tone_split(members: DataFrame, unstable: DataFrame | None = None, threshold: float = 0.6, compat: bool = False) -> DataFrame:
    """S9: (id, cogid, new_cogid, decision) for every member (id, cogid, pattern).

    unstable (cogid) limits the sets that are looked at; None or an empty table doesn't (Q-10). The cluster with a set's first
    member keeps the id; the others get new ids after the largest of all sets, or with compat of the sets looked at (Q-9).
    Members without tones keep theirs.
    """
    limited = unstable is not None and not unstable.isEmpty()
    looked = members.join(unstable.select("cogid").distinct(), "cogid", "left_semi") if limited else members
    clusters = kept(tone_clusters(looked, threshold), "clusters")
    decisions = split_decisions(clusters, looked.select("cogid").distinct())
    top = (looked if compat else members).agg(F.max("cogid").alias("top")).first().top or 0
    parts = clusters.join(decisions.where("decision = 'split'").select("cogid"), "cogid").groupBy("cogid", "cluster").agg(F.min("first").alias("first"))
    fresh = numbered(parts.where("cluster > 0"), ["cogid", "first"], "k").select("cogid", "cluster", (F.col("k") + top).alias("new"))
    moved = clusters.select("cogid", "pattern", "cluster").join(fresh, ["cogid", "cluster"]).select("cogid", "pattern", "new")
    rows = members.join(moved, ["cogid", "pattern"], "left").join(decisions.select("cogid", "decision"), "cogid", "left")
    return rows.select("id", "cogid", F.coalesce("new", "cogid").alias("new_cogid"), "decision")


DECISIONS = ("keep", "split", "review", "no_tone_data")


def decision_counts(decisions: DataFrame) -> DataFrame:
    """AG-13: (decision, n, pct) with a row for each kind, also without sets."""
    kinds = decisions.sparkSession.createDataFrame([(d,) for d in DECISIONS], "decision string")
    rows = kinds.join(decisions.groupBy("decision").agg(F.count("*").alias("n")), "decision", "left").fillna(0, ["n"])
    return rows.withColumn("pct", F.round(F.try_divide(100.0 * F.col("n"), F.sum("n").over(Window.partitionBy())), 6))


def split_details(split: DataFrame) -> DataFrame:
    """D12, SE-4, AG-15: a row for each set looked at, with the ids its members have after the split."""
    rows = split.where("decision is not null").groupBy("cogid", "decision").agg(F.count("*").alias("n_members"), F.array_sort(F.collect_set("new_cogid")).alias("ids"))
    return rows.select("cogid", "decision", "n_members", F.array_join(F.col("ids").cast("array<string>"), ",").alias("new_cogids"))
