"""Language identification by mixture inference.

Each language is a distribution over hashed byte trigrams of lower-cased letters, counted over
the training rows. A document's trigrams are taken as drawn from a mixture of languages;
expectation-maximisation finds the proportions. The set of languages is chosen by penalised
likelihood: languages enter in order of their proportion while twice the gain in log likelihood
exceeds the penalty.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import kept
from .words import chunks

BITS = 16  # of a trigram's bucket, for LANGUAGES languages at most; twice the languages take one bit less, so the model's size is bounded
LANGUAGES = 256
SMOOTHING = 0.1
ROUNDS = 30  # of expectation-maximisation at most
PENALTY = 3.0  # for each further language, times the log of the number of trigrams, which overlap by threes
UNDETERMINED = "und"

_LETTER = regex.compile(r"\p{L}")
_KEEP = np.full(256, 32, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray) -> np.ndarray:
    """Buckets of the byte trigrams of one text in lower case; what isn't a letter of ASCII counts as a space."""
    if len(data) == 0:
        return np.zeros(0, np.int64)
    x = _KEEP[np.concatenate([[32], data, [32, 32]])].astype(np.uint32)
    code = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
    code = code[code != 0x202020]
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, bucket, n), summed over the partition; what is held for more than LANGUAGES languages goes on before."""

    def sums() -> Iterator[pa.RecordBatch]:
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])
        total.clear()

    total: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(1 << BITS, np.int64))
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for at, end, data, offsets in chunks(pc.utf8_lower(batch.column(1))):
            for i in range(end - at):
                total[langs[at + i]] += np.bincount(trigrams(data[offsets[i] : offsets[i + 1]]), minlength=1 << BITS)
                if len(total) > LANGUAGES:
                    yield from sums()
    yield from sums()


def language_model(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, probabilities [bucket, language]) from all rows of labelled (lang, text) without nulls."""
    rows = labelled.select("lang", "text").where("lang is not null and text is not null")
    counts = kept(rows.mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    known = counts.agg(F.count_distinct("lang")).first()[0]
    fewer = max(0, (-(-known // LANGUAGES) - 1).bit_length())
    size = 1 << max(BITS - fewer, 6)
    own = counts.groupBy("lang", F.floor(F.col("bucket") / ((1 << BITS) // size)).cast("int").alias("bucket")).agg(F.sum("n").alias("n")).toPandas()  # LANGUAGES << BITS rows at most
    langs = sorted(set(own["lang"]))
    model = np.full((size, len(langs)), SMOOTHING)
    if langs:
        np.add.at(model, (own["bucket"].to_numpy(), np.searchsorted(np.array(langs, object), own["lang"].to_numpy(object))), own["n"].to_numpy())
    return langs, model / model.sum(0, keepdims=True) if langs else model


def _mixture(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """(proportions, log likelihood) of the languages in the columns of p, by expectation-maximisation."""
    share, total = np.full(p.shape[1], 1 / p.shape[1]), n.sum()
    for _ in range(ROUNDS):
        new = share * (p.T @ (n / (p @ share))) / total
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return share, float(n @ np.log(p @ share))


def infer(grams: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(languages' columns, their proportions, mean log likelihood of a trigram), the largest proportion first."""
    count = np.bincount(grams * len(model) >> BITS, minlength=len(model))
    at = np.flatnonzero(count)
    n, p = count[at].astype(float), model[at]
    total = n.sum()
    single = n @ np.log(p)
    best, cost = np.array([int(np.argmax(single))]), PENALTY * np.log(total + 1)
    share, like = np.ones(1), float(single.max())
    if p.shape[1] > 1:
        every, most = _mixture(p, n)
        order = np.argsort(-every, kind="stable")
        for k in range(2, p.shape[1] + 1):
            if 2 * (most - like) <= cost:  # no larger set can gain enough
                break
            s, x = _mixture(p[:, order[:k]], n)
            if 2 * (x - like) <= cost:
                break
            best, share, like = order[:k], s, x
    rank = np.argsort(-share, kind="stable")
    return best[rank], share[rank], like / total


def _identify(batches: Iterator[pa.RecordBatch], langs: list[str], model: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(batch.num_columns - 1)
        out: list[tuple] = []
        lower = pc.utf8_lower(text)
        for at, end, data, offsets in chunks(lower):
            for i in range(end - at):
                own = data[offsets[i] : offsets[i + 1]]
                if not langs or not _LETTER.search(own.tobytes().decode()):
                    out.append((UNDETERMINED, 0.0, [], [], None))
                    continue
                best, share, fit = infer(trigrams(own), model)
                names = [langs[k] for k in best]
                out.append((names[0], min(1.0, float(share[0])), names, share.tolist(), fit))
        cols = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.float64()))]
        names = [*batch.schema.names[:-1], "lang_pred", "score", "languages", "shares", "fit"]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], names=names)


def in_training(doc_id: Column) -> Column:
    """Whether a row may be learned from: crc32 of the id as text, mod 4, is not 2. A null id isn't learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(False))


def identify_languages(docs: DataFrame, labelled: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep of docs with lang_pred, score, languages, shares and fit, a row for each row of docs.

    languages: the selected set, the largest share first; lang_pred: the first of it; score: its
    share; fit: mean natural log likelihood of a trigram. Only text is an input. A null text, one
    without a letter (Unicode category L), or an empty model gives `und`, score 0, an empty set and a null fit. Equal texts get
    equal results. Of equal single-language likelihoods the first language by name wins. labelled
    (lang, text): rows with nulls teach nothing; any number of languages may be learned. Other columns are ignored. No rows in, none out.
    """
    langs, model = language_model(labelled)
    found = StructType.fromDDL("lang_pred string, score double, languages array<string>, shares array<double>, fit double")
    schema = StructType([*docs.select(*keep).schema.fields, *found.fields])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(*keep, F.col("text").alias("text of which the language is asked")).mapInArrow(lambda it: _identify(it, langs, shared.value), schema)
