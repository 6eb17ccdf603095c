"""Character matrices, NEXUS text and tree layouts (S11, S12)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.newick import nodes as newick_nodes
from ..sources.shared import dropped, kept
from .numbering import numbered, running_total

COLUMNS = 1_000  # characters of an interleaved block


BITS = 62  # languages of a word of bits


def class_rows(words: DataFrame, languages: list[str]) -> DataFrame:
    """AG-17, PR-8: (concept, cogid, label, has_0, ..., seen_0, ...) of words (language, concept, cogid): a row for each class.

    A class is keyed by concept and cogid, the label is for display (Q-15). Bit k of has is set if the k-th of the languages, in code point order, has
    the class, bit k of seen if it has the concept in any way. Cells and matrices follow from these rows, so nothing is as long as languages times classes
    before it is asked for.
    """
    place = F.create_map(*(x for k, c in enumerate(sorted(languages)) for x in (F.lit(c), F.lit(k)))) if languages else F.create_map().cast("map<string,int>")
    rows = words.where("concept is not null").select("concept", "cogid", F.try_element_at(place, F.col("language")).alias("k"))

    def bits(name: str) -> list[Column]:
        one = lambda w: F.when(F.expr(f"k div {BITS}") == w, F.expr(f"shiftleft(1L, k % {BITS})"))
        return [F.coalesce(F.bit_or(one(w)), F.lit(0).cast("long")).alias(f"{name}_{w}") for w in range(_words(languages))]

    own = rows.where("cogid is not null").groupBy("concept", "cogid").agg(*bits("has"))
    seen = rows.groupBy("concept").agg(*bits("seen"))
    return own.join(seen, "concept").withColumn("label", F.concat_ws("_", "concept", F.col("cogid").cast("string")))


def _words(languages: list[str]) -> int:
    return max(1, -(-len(languages) // BITS))


def _state(k: int, of=F.col) -> Column:
    """RE-5: 1 the k-th language has the class, 0 it has the concept otherwise, ? it doesn't. of: the column of a name."""
    bit = lambda name: F.getbit(of(f"{name}_{k // BITS}"), F.lit(k % BITS)) == 1
    return F.when(bit("has"), "1").when(bit("seen"), "0").otherwise("?")


def presence(words: DataFrame, languages: list[str]) -> DataFrame:
    """JO-9, RE-5: (language, concept, cogid, label, state) of each class in each language."""
    cells = F.array(*(F.struct(F.lit(c).alias("language"), _state(k).alias("state")) for k, c in enumerate(sorted(languages))))
    return class_rows(words, languages).select("concept", "cogid", "label", F.explode(cells).alias("cell")).select("cell.language", "concept", "cogid", "label", "cell.state")


def matrix(words: DataFrame, languages: list[str]) -> DataFrame:
    """SK-5: a row for each class, a column for each language; the languages are few, the classes are not."""
    return class_rows(words, languages).select("label", *(_state(k).alias(c) for k, c in enumerate(sorted(languages))))


def nexus_rows(words: DataFrame, languages: list[str], columns: int = COLUMNS) -> DataFrame:
    """SK-6, S-26: (block, language, line): the matrix of a NEXUS file, interleaved in blocks of classes in order of label.

    Names are padded to 15 characters, and longer ones kept whole.
    """
    own = [f"{name}_{w}" for name in ("has", "seen") for w in range(_words(languages))]
    rows = numbered(class_rows(words, languages), ["label", "concept", "cogid"], "nth").withColumn("block", F.floor((F.col("nth") - 1) / columns).cast("long"))
    blocks = rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("nth", *own))).alias("classes"))
    states = lambda k: F.array_join(F.transform("classes", lambda c: _state(k, lambda n: c[n])), "")
    lines = F.array(*(F.struct(F.lit(c).alias("language"), states(k).alias("states")) for k, c in enumerate(sorted(languages))))
    lines = blocks.select("block", F.explode(lines).alias("of")).select("block", "of.language", "of.states")
    name = T.taxon(F.col("language"))
    return lines.select("block", "language", F.concat(F.rpad(name, F.greatest(F.lit(15), F.length(name)), F.lit(" ")), F.lit(" "), "states").alias("line"))


def nexus(words: DataFrame, languages: list[str], columns: int = COLUMNS) -> DataFrame:
    """(place, line): all lines of a NEXUS file, to be written in order of place."""
    rows = kept(nexus_rows(words, languages, columns), "nexus")
    spark, last = words.sparkSession, F.max(F.struct("block", F.length(F.regexp_extract("line", r"(\S+)$", 1)).alias("n"))).alias("last")
    n = rows.select(last).select((F.col("last.block") * columns + F.col("last.n")).alias("n")).first().n or 0
    head = ["#NEXUS", "", "BEGIN DATA;", f"    DIMENSIONS NTAX={len(languages)} NCHAR={n};", '    FORMAT DATATYPE=STANDARD SYMBOLS="01" GAP=- MISSING=? INTERLEAVE=YES;', "    MATRIX"]
    tail = ["    ;", "END;", "", "BEGIN ASSUMPTIONS;", f"    CHARSET all = 1-{n};", "END;"]
    place = F.struct(F.col("part").alias("part"), F.col("block").alias("block"), F.col("language").alias("language"))
    fixed = spark.createDataFrame([(p, k, "", x) for p, lines in ((0, head), (2, tail)) for k, x in enumerate(lines)], "part int, block long, language string, line string")
    return fixed.unionByName(rows.select(F.lit(1).alias("part"), "block", "language", "line")).select(place.alias("place"), "line")


def read_nexus(lines: DataFrame) -> DataFrame:
    """(block, taxon, states, n_taxa, n_chars) of the lines (place, line) of an interleaved NEXUS file: its matrix, and the numbers its head has.

    place orders the lines. A matrix goes from the line MATRIX to a line of one semicolon; a taxon's lines are its blocks.
    """
    edge = lines.agg(F.min(F.when(F.upper(F.trim("line")) == "MATRIX", F.col("place"))).alias("start"), F.max(F.regexp_extract("line", r"NTAX=(\d+)", 1)).alias("n_taxa"), F.max(F.regexp_extract("line", r"NCHAR=(\d+)", 1)).alias("n_chars"))
    body = lines.join(F.broadcast(edge), F.col("place") > F.col("start"))  # one row
    end = body.where(F.trim("line") == ";").agg(F.min("place").alias("end"))
    body = body.join(F.broadcast(end), F.col("place") < F.col("end"))  # one row
    split = body.select("place", F.regexp_extract("line", r"^\s*(\S+)\s+(\S+)\s*$", 1).alias("taxon"), F.regexp_extract("line", r"^\s*(\S+)\s+(\S+)\s*$", 2).alias("states"), "n_taxa", "n_chars")
    rows = numbered(split.where("taxon <> ''"), ["place"], "nth", within="taxon")
    return rows.select((F.col("nth") - 1).alias("block"), "taxon", "states", F.col("n_taxa").cast("long").alias("n_taxa"), F.col("n_chars").cast("long").alias("n_chars"))


def tree_batch(trees: DataFrame) -> DataFrame:
    """TR-8: (file, node_id, parent_id, child_ord, label, length, posterior, error) of trees (file, newick), a batch of files.

    A file without a tree, or with one that can't be read, has one row, with an error and nulls; the others are not touched by it.
    """
    cols = ["file", "node_id", "parent_id", "child_ord", "label", "length", "posterior", "error"]

    def read(file: str, newick: str | None) -> list[tuple]:
        if not newick:
            return [(file, *[None] * 6, "no tree")]
        try:
            return [(file, *n, None) for n in newick_nodes(newick)]
        except (ValueError, IndexError) as e:
            return [(file, *[None] * 6, f"malformed tree: {e}")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [n for f, x in zip(b["file"], b["newick"]) for n in read(f, x)]
            kinds = {"node_id": "Int64", "parent_id": "Int64", "child_ord": "Int64", "length": "Float64", "posterior": "Float64"}
            yield pd.DataFrame(rows, columns=cols).astype(kinds)

    schema = "file string, node_id long, parent_id long, child_ord long, label string, length double, posterior double, error string"
    return trees.select("file", "newick").mapInPandas(parse, schema)


def parse_trees(trees: DataFrame) -> DataFrame:
    """SC-8, TR-5: (file, node_id, parent_id, child_ord, label, length, posterior) of the trees (file, newick) that can be read; annotations belong to their node."""
    return tree_batch(trees).where("error is null").drop("error")


ROUNDS = 62  # more than any tree can need


def doubled(nodes: DataFrame, down: tuple[str, ...], up: tuple[str, ...], weight: str | None = None) -> DataFrame:
    """nodes (node_id, parent_id, ...) with columns down summed from the root to each node, and columns up over each node's subtree.

    weight: a column of what a node's sum counts for in its parent's, 1 without one. Every round a node looks as far again as in all rounds before:
    it adds what the node that far above it has, and what those that far below it have. A tree of d levels takes log2(d) rounds.
    """
    extra = [weight] if weight else []
    state = kept(nodes.select("node_id", F.col("parent_id").alias("far"), *down, *up, *extra), "doubled")
    for _ in range(ROUNDS):
        if state.where("far is not null").isEmpty():
            return state.drop("far", *extra)
        above = state.select(F.col("node_id").alias("far"), F.col("far").alias("farther"), *(F.col(c).alias(f"above_{c}") for c in (*down, *extra)))
        sums = [F.sum(F.col(c) * F.col(weight) if weight else F.col(c)).alias(f"below_{c}") for c in up]
        new = state.join(above, "far", "left")
        if up:
            below = state.where("far is not null").groupBy(F.col("far").alias("node_id")).agg(*sums)
            new = new.join(below, "node_id", "left")
        add = lambda c, side: (F.col(c) + F.coalesce(F.col(f"{side}_{c}"), F.lit(0))).alias(c)
        product = [(F.col(c) * F.coalesce(F.col(f"above_{c}"), F.lit(1.0))).alias(c) for c in extra]
        old, state = state, kept(new.select("node_id", F.col("farther").alias("far"), *(add(c, "above") for c in down), *(add(c, "below") for c in up), *product), "doubled")
        dropped(old)
    raise ValueError("nodes are their own ancestors")


def layout(nodes: DataFrame) -> DataFrame:
    """TR-2, TR-3: nodes (node_id, parent_id, child_ord, length) of one tree with depth, x, y, is_tip.

    x is the distance from the root; tips get y 0, 1, ... from left to right; another node has the mean of its children's y. With s as the tips in a node's
    earlier siblings, sums of s from the root down are the tips before a node, and a node is above the first of its own tips by the mean over its children of
    s and what they are above theirs: both are sums that doubling finds, and no step goes level by level.
    """
    rows = kept(nodes.select("node_id", "parent_id", "child_ord", "length"), "nodes")
    inner = rows.where("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("children"))
    root = F.col("parent_id").isNull()
    rows = rows.join(inner, "node_id", "left").select("*", F.col("children").isNull().alias("is_tip"), F.when(root, 0).otherwise(1).cast("long").alias("depth"), F.when(root, 0.0).otherwise(F.col("length")).alias("x"))
    rows = kept(rows.withColumn("tips", F.col("is_tip").cast("long")), "nodes")
    sums = doubled(rows, ("depth", "x"), ("tips",))
    known = rows.drop("depth", "x", "tips").join(sums, "node_id")
    ahead = running_total(known, ["child_ord", "node_id"], "tips", "upto", within="parent_id")
    ahead = kept(ahead.withColumn("s", F.when(root, 0).otherwise(F.col("upto") - F.col("tips"))), "siblings")
    mean = ahead.where("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.avg("s").alias("above"))
    counts = ahead.where("children is not null").select(F.col("node_id").alias("parent_id"), F.col("children").alias("of"))
    part = ahead.select("node_id", "parent_id", "s").join(mean, "node_id", "left").join(counts, "parent_id", "left")
    part = part.select("node_id", "parent_id", "s", F.coalesce("above", F.lit(0.0)).alias("above"), F.coalesce(1.0 / F.col("of"), F.lit(1.0)).alias("share"))
    high = doubled(part, ("s",), ("above",), "share")
    placed = ahead.drop("s").join(high, "node_id")
    return kept(placed.select("node_id", "parent_id", F.col("depth").cast("int").alias("depth"), "x", (F.col("s") + F.col("above")).alias("y"), "is_tip"), "layout")


def segments(placed: DataFrame) -> DataFrame:
    """TR-4: (node_id, x0, y0, x1, y1, kind) of the lines to draw: horizontal at the child's y, vertical at the parent's x."""
    up = placed.select(F.col("node_id").alias("up"), F.col("x").alias("px"), F.col("y").alias("py"))
    rows = placed.join(up, F.col("parent_id") == F.col("up"))
    flat = rows.select("node_id", F.col("px").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.lit("horizontal").alias("kind"))
    tall = rows.select("node_id", F.col("px").alias("x0"), F.col("py").alias("y0"), F.col("px").alias("x1"), F.col("y").alias("y1"), F.lit("vertical").alias("kind"))
    return flat.unionByName(tall)


def support_labels(posterior: Column) -> tuple[Column, Column]:
    """TR-5: (text, font size) of a node's posterior: shown from 0.1 on, larger from 0.95 on."""
    shown = posterior >= 0.1
    return F.when(shown, F.format_string("%.3f", posterior)), F.when(shown, F.when(posterior >= 0.95, 7).otherwise(6))


def tip_labels(tips: DataFrame, names: DataFrame, colours: DataFrame) -> DataFrame:
    """PR-7, TR-6: tips (label) with name (by code, else the label) and colour (by the name's first code, else black)."""
    of_name = names.groupBy("name").agg(F.min_by("code", "ord").alias("code")).join(colours, "code", "left").select("name", "colour")
    rows = tips.join(names.select(F.col("code").alias("label"), "name"), "label", "left").withColumn("name", F.coalesce("name", "label"))
    return rows.join(of_name, "name", "left").withColumn("colour", F.coalesce("colour", F.lit("black")))


def drawing(placed: DataFrame) -> DataFrame:
    """TR-6: one row: tips, depth, scale bar (a tenth of the depth) and height of the figure."""
    n = F.count_if("is_tip")
    return placed.agg(n.alias("tips"), F.max("x").alias("depth"), (F.max("x") / 10).alias("scale"), F.greatest(F.lit(8.0), 0.25 * n).alias("height"))
