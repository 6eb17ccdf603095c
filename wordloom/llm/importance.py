"""Resampling by importance: documents are drawn so that their features become like those of target texts.

Features are runs of 1 to n words in hashed buckets. Newlines cut texts into lines; each distinct line of the table has its features
computed once, and what it weighs is multiplied by how often it occurs; runs of words across lines are added on their own, from the texts.
The draw takes the largest sums of a document's weight and a Gumbel number that follows from its id, so it is without replacement.

A word is a run of a-z, 0-9 and what isn't ASCII, after A-Z have become a-z. Null text has no words.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .shared import kept
from .words import chunks, cut

SLICE = 4 << 20  # bytes of text whose features are at hand at once; a longer text's are alone
LONG = 64  # bytes of a feature that is hashed by itself
MILLI = 1000  # gains and scores are whole thousandths

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_CRC = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)  # linear in the byte, so the table follows


def _crc32(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of each slice, a byte of all of them at a time."""
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    n_long = int(np.searchsorted(-size, -LONG))
    for k in range(min(int(size[n_long]) if n_long < len(size) else 0, LONG)):
        live = slice(n_long, int(np.searchsorted(-size, -k)))
        crc[live] = _CRC[(crc[live] ^ data[start[live] + k]) & np.uint32(255)] ^ (crc[live] >> np.uint32(8))
    out = np.empty(len(start), np.uint32)
    out[order] = ~crc
    for k in range(n_long):
        out[order[k]] = zlib.crc32(data[start[k] : start[k] + size[k]].tobytes())
    return out


def features(column: pa.Array, n: int, buckets: int, across: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, number of features of each text, number of words of each text); across: only of runs that newlines part."""
    found, per, words = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at, end, data, offsets in chunks(column):
        low = _LOW[data]
        solid = _WORD[low]
        start = solid.copy()
        start[1:] &= ~solid[:-1]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        start[edges] |= solid[edges]
        starts, body = np.flatnonzero(start), np.flatnonzero(solid)
        first = np.searchsorted(starts, offsets)
        word = np.cumsum(start)[body] - 1
        joined = np.full(len(body) + len(starts), 32, np.uint8)  # words with one space after each
        joined[np.arange(len(body)) + word] = low[body]
        size = np.bincount(word, minlength=len(starts)).astype(np.int64)
        place = np.cumsum(size + 1) - size - 1
        text = np.repeat(np.arange(end - at), np.diff(first))
        line = np.searchsorted(np.flatnonzero(data == 10), starts) if across else None
        buckets_, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(2 if across else 1, n + 1):
            runs = np.arange(max(len(starts) - k + 1, 0))
            runs = runs[text[runs] == text[runs + k - 1]]
            if across:
                runs = runs[line[runs] != line[runs + k - 1]]
            last = runs + k - 1
            buckets_.append(_crc32(joined, place[runs], place[last] + size[last] - place[runs]).astype(np.int64) % buckets)
            of.append(text[runs])
        of = np.concatenate(of)
        order = np.argsort(of, kind="stable")
        found.append(np.concatenate(buckets_)[order])
        per.append(np.bincount(of, minlength=end - at))
        words.append(np.diff(first))
    return np.concatenate(found), np.concatenate(per), np.concatenate(words)


def _featured(n: int, buckets: int, across: bool, text: str):
    """Batches with a column of texts last to batches with (n_words, features) in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, text, SLICE):
                found, per, words = features(part.column(part.num_columns - 1), n, buckets, across)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), pa.array(found, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(words, pa.int64()), lists], names=[*part.schema.names[:-1], "n_words", "features"])

    return run


def line_features(docs: DataFrame, n: int = 1, buckets: int = 10_000, text: str = "text") -> DataFrame:
    """(line, n, n_words, features): each distinct line of all texts once, as its MD5 digest, with the number of its occurrences and its buckets."""
    lines = docs.select(F.explode(F.split(F.coalesce(docs[text], F.lit("")), "\n", -1)).alias("line_text")).groupBy("line_text").agg(F.count("*").alias("n"))
    lines = lines.select(F.unhex(F.md5("line_text")).alias("line"), "n", "line_text")
    return lines.mapInArrow(_featured(n, buckets, False, "line_text"), "line binary, n long, n_words long, features array<int>")


def across_lines(rows: DataFrame, n: int, buckets: int, text: str = "text") -> DataFrame:
    """(row, n_words, features): of each row's runs of 2 to n words those that newlines part."""
    return rows.select("row", F.coalesce(F.col(text), F.lit("")).alias("whole")).mapInArrow(_featured(n, buckets, True, "whole"), "row long, n_words long, features array<int>")


def bucket_counts(*tables: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """Features of tables (n, features) in each bucket, occurrences counted. Tasks sum their own before anything moves."""
    out = np.zeros(buckets, np.int64)
    for table in tables:
        each = table.select("n", F.explode("features").alias("bucket")).groupBy("bucket").agg(F.sum("n").alias("n"))
        for r in each.collect():  # as many rows as buckets
            out[r.bucket] += r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> list[int]:
    """What a feature of each bucket adds to a document's weight: the log of how much likelier the target is to have it."""
    b, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return [math.floor(MILLI * math.log((float(y) + 1) * (s + b) / ((float(x) + 1) * (t + b)))) for x, y in zip(corpus.tolist(), target.tolist())]


def _weighed(gain: list[int]):
    """Batches (key, n_words, features) to (key, n_words, n_features, weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(gain, np.int64)
        for batch in batches:
            count = batch.column(2).value_lengths().to_numpy().astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(table[batch.column(2).flatten().to_numpy()])])
            end = np.cumsum(count)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(count), pa.array(upto[end] - upto[end - count])], names=["key", "n_words", "n_features", "weight"])

    return run


def gumbel(doc_id, seed: int):
    """Whole thousandths of a Gumbel number of an id: from the first 32 bits of the SHA-256 digest of `seed:id`; a null id is written as nothing."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(MILLI)) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, n_words) of every document, all long but doc_id.

    docs: (doc_id, text), target: (text). Of the documents with least_words words the given percentage, rounded down, is drawn: rank is 1, 2, ...
    by score, ties by doc_id, a null one first; others have null. Rows with the same id and text have the same weight and follow each other.
    Without features a weight is 0. An empty target makes all gains follow from the corpus alone; empty docs give an empty table. Other columns
    may have any names and are left behind.
    """
    rows = docs.select("doc_id", docs["text"].alias("text"), F.monotonically_increasing_id().alias("row"))
    own = kept(line_features(docs, n, buckets), "line-features")
    wanted = [line_features(target, n, buckets)]
    counted = [own]
    if n > 1:  # numbers of rows hold once they are written
        rows = kept(rows, "numbered-rows")
        more = kept(across_lines(rows, n, buckets).select("row", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("n_words"), "features"), "across-lines")
        counted.append(more)
        wanted.append(across_lines(target.select("text", F.lit(0).cast("long").alias("row")), n, buckets).withColumn("n", F.lit(1).cast("long")))
    gain = gains(bucket_counts(*counted, buckets=buckets), bucket_counts(*wanted, buckets=buckets))
    shape = "n_words long, n_features long, weight long"
    weights = own.select(F.col("line").alias("key"), "n_words", "features").mapInArrow(_weighed(gain), f"key binary, {shape}")
    lines = kept(rows.select("row", "doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line")).select("row", "doc_id", F.unhex(F.md5("line")).alias("line")), "lines")
    parts = lines.join(weights.hint("merge"), lines["line"] == weights["key"]).select("row", "doc_id", "n_words", "n_features", "weight")
    if n > 1:
        rest = more.select(F.col("row").alias("key"), "n_words", "features").mapInArrow(_weighed(gain), f"key long, {shape}")
        parts = parts.unionByName(rows.select("row", "doc_id").join(rest, rows["row"] == rest["key"]).select(*parts.columns))
    whole = parts.groupBy("row", "doc_id").agg(*(F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")))
    whole = kept(whole.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "weights")
    drawn = percent * whole.where(F.col("n_words") >= least_words).count() // 100
    ranked = numbered(whole.where(F.col("n_words") >= least_words), [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("row")], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = whole.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def crc32_sql(hexed: str) -> str:
    """DuckDB SQL: CRC-32 of the bytes that a text in hexadecimal stands for; needs a list `crc` of 256 numbers in scope."""
    data = f"list_transform(range(1, length({hexed}), 2), lambda i: ('0x' || substr({hexed}, i::INTEGER, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda a, b: xor(crc[(xor(a, b) & 255) + 1], a >> 8)), 4294967295::BIGINT)"


#: The list that crc32_sql needs: eight steps of division for each byte.
CRC_SQL = """SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda p, q: xor(p >> 1, 3988292384::BIGINT * (p & 1)))) AS crc"""


def resampled_sql() -> str:
    """resampled over documents and benchmark with n = 1, in DuckDB SQL."""
    words = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""WITH c AS ({CRC_SQL}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({words}, []) AS w FROM documents), q AS (SELECT {words} AS w FROM benchmark WHERE text IS NOT NULL),
dw AS (SELECT r, unnest(w) AS x FROM d), qw AS (SELECT unnest(w) AS x FROM q),
b AS (SELECT x, {crc32_sql("hex(x)")} % 10000 AS bucket FROM (SELECT x FROM dw UNION SELECT x FROM qw), c),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN b USING (x) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM qw JOIN b USING (x) GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM dw)::DOUBLE AS big_s, (SELECT count(*) FROM qw)::DOUBLE AS big_t),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (big_s + 10000) / ((s + 1)::DOUBLE * (big_t + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), n),
v AS (SELECT r, sum(gain) AS weight FROM dw JOIN b USING (x) JOIN g USING (bucket) GROUP BY 1),
e AS (SELECT r, doc_id, len(w)::BIGINT AS n_words, coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN v USING (r)),
f AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM e),
k AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST) END AS place, count(*) FILTER (n_words >= 20) OVER () AS of FROM f)
SELECT doc_id, n_words AS n_features, weight, score, CASE WHEN place <= 10 * of // 100 THEN place END AS rank, n_words FROM k"""
