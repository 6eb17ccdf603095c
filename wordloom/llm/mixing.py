"""Mixing sources to target weights by entropy balancing.

Among all document rates whose taken words meet each source's target, entropy balancing takes those nearest to one copy
of every document, in relative entropy, with rates of cap at most. The solution tilts rates exponentially in a document's tokens,
rate = min(cap, exp(multiplier * size)), one multiplier for each source's token constraint, so long documents move further than
short ones. The multipliers solve a convex dual, whose gradient is the words taken less the target and whose
curvature is the sum of size squared times rate below the cap. Newton steps sum both over (source, size) classes on the cluster; a
step that leaves the bracket known so far is halved into it. Rates become whole copies by error diffusion: within
strata of a source, from large documents to small ones, what rounding has given too much or too little so far goes into the
next document's copies.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .shared import kept, n_words

STRATUM = 4096  # documents that are rounded together, about
STEPS = 200  # Newton steps at most; about ten are needed
STRIDE = 4.0  # the most that a step moves a multiplier, in exponents of a document of mean size
TOLERANCE = 1e-9
SURE = 1e9  # a multiplier that means all rates at the cap


def capped_targets(sources: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """sources (source, source_size) with target: shares of all words by weight, none above cap times its size.

    Sources in code point order, null last, get the weights in turn, again and again. The level, words for each
    unit of weight, rises as sources are capped, until no further one is: each round is an aggregate over the sources.
    """
    order = [F.col("source").asc_nulls_last()]
    turn = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("nth") - 1) % len(weights) + 1).cast("int"))
    rows = numbered(sources, order, "nth").select("source", "source_size", turn.alias("weight"), (F.col("source_size") * float(cap)).alias("most"))
    rows = kept(rows, "weighted")
    total, capped, level = rows.agg(F.sum("source_size")).first()[0], -1, 0.0
    while total:
        full = F.col("most") <= F.col("weight") * level
        n, used, open_ = rows.agg(F.count_if(full), F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(~full, F.col("weight")).otherwise(0.0))).first()
        if n == capped or not open_:
            break
        capped, level = n, (total - used) / open_
    return rows.select("source", "source_size", F.least("most", F.col("weight") * level).alias("target"))


def rate_of(multiplier: Column, size: Column, cap: float) -> Column:
    """The tilted rate of a document."""
    tilt = multiplier * size
    return F.when(tilt >= F.log(F.lit(float(cap))), F.lit(float(cap))).otherwise(F.exp(tilt))


def multipliers(classes: DataFrame, targets: DataFrame, cap: float = 3.0) -> DataFrame:
    """(source, source_size, target, multiplier): Newton steps on the dual. classes: (source, size, n), targets: (source, source_size, target, n_docs)."""
    none = F.lit(None).cast("double")
    sure = F.col("target") >= F.col("source_size") * float(cap) * (1 - 1e-12)
    state = targets.select(
        "source", "source_size", "target", (F.col("source_size") / F.col("n_docs")).alias("mean"),
        F.when(sure, F.lit(SURE)).otherwise(F.lit(0.0)).alias("multiplier"), none.alias("low"), none.alias("high"), (sure | (F.col("source_size") == 0)).alias("done"),
    )
    state = kept(state, "dual")
    for _ in range(STEPS):
        if state.where("not done").isEmpty():
            break
        open_ = state.where("not done").select(F.col("source").alias("of"), "multiplier")
        rows = classes.join(open_, F.col("source").eqNullSafe(F.col("of")))
        rate = rate_of(F.col("multiplier"), F.col("size"), cap)
        words = F.col("n") * F.col("size") * rate
        sums = rows.groupBy("of").agg(F.sum(words).alias("mass"), F.sum(F.when(rate < cap, words * F.col("size")).otherwise(0.0)).alias("slope"))
        off = F.col("mass") - F.col("target")
        step = state.join(sums, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        step = step.withColumn("low", F.when(off < 0, F.col("multiplier")).otherwise(F.col("low"))).withColumn("high", F.when(off > 0, F.col("multiplier")).otherwise(F.col("high")))
        most = STRIDE / F.col("mean")
        newton = F.col("multiplier") + F.greatest(-most, F.least(most, F.coalesce(F.try_divide(-off, F.col("slope")), -F.signum(off) * most)))
        inside = (F.col("low").isNull() | (newton > F.col("low"))) & (F.col("high").isNull() | (newton < F.col("high")))
        new = F.when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        ends = F.abs(off) <= TOLERANCE * F.col("target")
        step = step.withColumn("new", F.when(F.col("done") | ends, F.col("multiplier")).otherwise(new)).withColumn("done", F.col("done") | ends | (F.col("new") == F.col("multiplier")))
        state = kept(step.select("source", "source_size", "target", "mean", F.col("new").alias("multiplier"), "low", "high", "done"), "dual")
    return state.select("source", "source_size", "target", "multiplier")


def _rounded(group: pd.DataFrame) -> pd.DataFrame:
    """Copies that the n equal documents of each row take together, in one stratum: each the floor or ceiling of the rate, so that the words taken so far are nearest to what is due.

    What a document larger than all that follow leaves over is made up for by further copies of those, or fewer.
    """
    group = group.sort_values(["size", "key"], ascending=[False, True], kind="stable")
    copies, owed = [], 0.0
    for size, rate, most, n in zip(group["size"].tolist(), group["rate"].tolist(), group["most"].tolist(), group["n"].tolist()):
        low = int(rate)
        due = owed + n * (rate - low) * size
        more = 0 if size == 0 or low >= most else min(max(math.floor(due / size + 0.5), 0), n)
        owed = due - more * size
        copies.append(n * low + more)
    for k, (size, most, n) in enumerate(zip(group["size"].tolist(), group["most"].tolist(), group["n"].tolist())):
        if size and abs(owed) >= size / 2:
            total = min(max(copies[k] + int(round(owed / size)), 0), n * most)
            if abs(owed - (total - copies[k]) * size) < abs(owed):
                owed -= (total - copies[k]) * size
                copies[k] = total
    return pd.DataFrame({"key": group["key"], "size": group["size"], "of": group["of"], "n": group["n"], "total": copies})


AT_ONCE = 1 << 16  # rows that one row gives rise to at once


def mixed(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, rate) for every row of docs (doc_id, text, source).

    size counts the words of the text (null: 0), source_size all words of the row's source, target
    what the mix should take of it, rate the document's tilted rate, copies how often the mix takes the document, taken = copies * size.
    Null sources are one source, the last. A document without words has rate 1 and is taken once; a source without words has
    target 0. Rows with equal ids and sizes are counted before they are rounded, and share their copies as evenly as these go. doc_id may be of any
    type that casts to text and back; null ids stay null. Other columns are ignored. No rows in, none out.
    """
    kind = docs.schema["doc_id"].dataType
    sized = kept(docs.select("doc_id", "source", n_words(F.col("text")).cast("long").alias("size")), "sized")
    classes = kept(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "classes")
    sources = kept(classes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs")), "sources")
    counted = sources.select(F.col("source").alias("of"), "n_docs")
    targets = capped_targets(sources.drop("n_docs"), weights, cap).join(counted, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    state = multipliers(classes, targets, cap).join(counted, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    # numbered in code point order, so that reruns agree
    state = kept(numbered(state, [F.col("source").asc_nulls_last()], "of"), "mixed")
    rates = state.select(F.col("source").alias("named"), "of", "multiplier", F.ceil(F.col("n_docs") / STRATUM).alias("strata"))
    rows = sized.join(rates, F.col("source").eqNullSafe(F.col("named"))).select(
        F.col("doc_id").cast("string").alias("key"), "size", "of", F.when(F.col("size") > 0, rate_of(F.col("multiplier"), F.col("size"), cap)).otherwise(F.lit(1.0)).alias("rate"),
        F.lit(cap).alias("most"), F.pmod(F.xxhash64("doc_id", "size"), "strata").alias("stratum"),
    )
    rows = rows.groupBy("of", "stratum", "key", "size", "rate", "most").agg(F.count("*").alias("n"))
    totals = rows.groupBy("of", "stratum").applyInPandas(_rounded, "key string, size long, of long, n long, total long")
    each = totals.withColumn("many", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {AT_ONCE}"))))
    each = each.withColumn("few", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(AT_ONCE - 1), F.col("n") - 1 - AT_ONCE * F.col("many")))))
    nth = F.col("many") * AT_ONCE + F.col("few")
    copies = each.select("key", "size", "of", (F.expr("total div n") + F.when(nth < F.expr("total % n"), 1).otherwise(0)).alias("copies"))
    out = copies.join(state.select("of", "source_size", "target", "multiplier"), "of")
    rate = F.when(F.col("size") > 0, rate_of(F.col("multiplier"), F.col("size"), cap)).otherwise(F.lit(1.0))
    return out.select(F.col("key").cast(kind).alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", F.round(rate, 9).alias("rate"))
