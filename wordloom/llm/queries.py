"""The queries opN_<name> of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import decoded, encoded
from .decontaminate import contained_items
from .importance import resampled, resampled_sql
from .kneser_ney import quality
from .language_id import identify_languages, in_training
from .licences import licences_sql, scan_licences
from .mixing import mixed
from .ngram_join import ngram_jaccard_join
from .pitman_yor import held_out, score_texts
from .prefix_trie import prefix_trie, prefix_trie_sql
from .secrets import secrets_found, secrets_sql
from .shared import bounded_batches
from .transport_stream import inspected, stored
from .url_filter import judged, labelled_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(_table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"), shingle=3, threshold=90)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(~in_training(F.col("doc_id")), F.lit(False)) & F.col("doc_id").isNotNull())
    found = identify_languages(docs, docs.where(in_training(F.col("doc_id"))), keep=("doc_id", "held_out"))
    return found.select(
        "doc_id", "held_out", "lang_pred", "score", F.array_join("languages", ",").alias("languages"), F.round("fit", 6).alias("fit")
    )


def op5_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_texts(docs, ~held_out(F.col("doc_id"))).withColumn("held_out", held_out(F.col("doc_id")))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(_table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_found(_table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(_table(spark, sf_dir, "pages"), labelled_urls(spark))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inspected(stored(_table(spark, sf_dir, "documents")))
    return found.drop("timestamps", "random_access")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = encoded(_table(spark, sf_dir, "documents"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    tokens = tokens.withColumns({"n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(ids.cast("binary"), 256)})
    back = decoded(tokens, keep=("doc_id", "n_tokens", "ids_sha256"))
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("data", 256).alias("decoded_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_decontamination,
            op2_mix_sources,
            op3_ngram_jaccard_join,
            op4_language_id,
            op5_pitman_yor,
            op6_licence_scan,
            op7_secret_scan,
            op8_url_filter,
            op9_quality,
            op10_transport_stream,
            op11_byte_bpe,
            op12_importance_resampling,
            op13_prefix_trie,
        )
    }


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_WORDS = "regexp_extract_all({text}, '[^\x20\x09-\x0D]+')".format(text=_LOW)
#: Words of documents d and items q; an item of fewer than five words is one shingle of that many.
_OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
q AS (SELECT row_number() OVER () AS i, item_id, least(len(w), 5) AS k, w FROM (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0),
q1 AS (SELECT i, item_id, k, unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' ')))) AS x FROM q),
n AS (SELECT i, count(*) AS n_item FROM q1 GROUP BY i),
d1 AS (SELECT r, doc_id, k, unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' ')))) AS x FROM d, (SELECT DISTINCT k FROM q) WHERE len(w) >= k)
SELECT any_value(doc_id) AS doc_id, any_value(item_id) AS item_id, any_value(n_item)::BIGINT AS n_item, count(*)::BIGINT AS n_common
FROM d1 JOIN q1 USING (k, x) JOIN n USING (i) GROUP BY r, i HAVING 100 * count(*) >= 80 * any_value(n_item)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": _OP1_SQL, "op6_licence_scan": licences_sql(), "op7_secret_scan": secrets_sql(), "op12_importance_resampling": resampled_sql(), "op13_prefix_trie": prefix_trie_sql()}
