"""Figures about a table that are taken while it is written, so that nothing is read twice (SK-8, AG-3 to AG-6, AG-16)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as T


def written(df: DataFrame, write: Callable[[DataFrame], object], metrics: dict[str, Column]) -> dict[str, object]:
    """Runs write, which must be one job over all of df, and gives the metrics of the rows that went through it. Metrics are aggregates without distinct."""
    seen = Observation()
    write(df.observe(seen, *(m.alias(name) for name, m in metrics.items())))
    return {name: seen.get[name] for name in metrics}


def match_metrics() -> dict[str, Column]:
    """AG-6: of matches (method, score)."""
    return {
        "total": F.count(F.lit(1)), "n_exact": F.count_if(F.col("method") == "exact"), "n_fuzzy": F.count_if(F.col("method") == "fuzzy"), "n_scored": F.count("score"),
    }


def coverage_metrics() -> dict[str, Column]:
    """AG-3, AG-5: of wide rows (concept_id, pos, n), n being the number of languages."""
    return {"n_rows": F.count(F.lit(1)), "min_langs": F.min("n"), "max_langs": F.max("n"), "n_forms": F.sum("n"), "n_concepts": F.count_if(F.col("pos") == 0), "most_synonyms": F.max("pos") + 1}


def tone_metrics() -> dict[str, Column]:
    """AG-16: of words (form, n, plain)."""
    return {"words": F.sum("n"), "changed": F.sum(F.when(F.col("form") != F.col("plain"), F.col("n")).otherwise(0))}


def stripped(words: DataFrame) -> DataFrame:
    """words (form, n) with plain: the form without tone."""
    return words.withColumn("plain", T.strip_tone(F.col("form")))
