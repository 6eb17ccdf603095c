"""What the operators of this subpackage share: tables kept in the shared folder, and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import bounded_batches, dropped, kept, shared_folder

__all__ = ["GAPS", "bounded_batches", "columns_of", "dropped", "kept", "looked_up", "n_words", "shared_folder", "text_bytes"]

#: `[^\x20\x09-\x0D]+` is a word: Java's class of what stands between words.
GAPS = r"[\x20\x09-\x0D]+"


SMALL_ROWS = 1_000_000


def looked_up(df: DataFrame, name: str) -> DataFrame:
    """df, kept and marked for a join: broadcast if it has SMALL_ROWS rows of a few numbers at most, else for a merge join.

    A kept table has an exchange of its own, so that adaptive execution can split hot keys of a merge join.
    """
    df = kept(df, name)
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df.hint("merge")


def columns_of(df: DataFrame) -> list[F.Column]:
    """The columns of df, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def n_words(text) -> F.Column:
    """Number of words of a text; null counts as empty."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), GAPS), lambda w: w != ""))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts, from which numbers of shards and blocks follow."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
