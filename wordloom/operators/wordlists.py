"""Pages to wordlists, wide and long form, and coverage (S1, S2, RE-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import kept
from ..sources.tables import require
from .numbering import first_seen, numbered

# Words that look like language codes but aren't.
NOISE = (
    "East", "West", "to", "from", "the", "and", "or", "in", "of", "at", "on", "with", "by", "for", "as", "is", "are", "was", "were", "be", "been",
    "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "can", "must", "shall",
    "Town", "River", "Delta", "Code", "Lect", "Sources", "Nembe", "Notes",
)
# How some lines name their language instead of by its code, in the order they are tried.
MARKERS = (("Ịb", "IB"), ("Ịban", "IB"), ("Kala", "KA"), ("Kalab", "KA"), ("Nembe", "NE"), ("Defaka", "DE"))
FIRST_WORD = rf"^((?:(?!{T.BLANK}).)+)"


def language_codes(pages: DataFrame, first: int = 2, last: int = 4, noise: tuple[str, ...] = NOISE) -> DataFrame:
    """SC-2: (code, n_lines): two-letter first words of the lines of some pages (doc, page_no, text), noise words left out.

    A document whose last page is before the last of these gives none.
    """
    whole = pages.groupBy(F.col("doc").alias("whole")).agg(F.max("page_no").alias("pages")).where(F.col("pages") >= last)
    pages = pages.join(whole, F.col("doc").eqNullSafe(F.col("whole")), "left_semi")
    lines = pages.where(F.col("page_no").between(first, last)).select(F.explode(F.split("text", "\n")).alias("line"))
    words = lines.select(F.regexp_extract(T.strip(F.col("line")), FIRST_WORD, 1).alias("code"))
    return words.where(F.col("code").rlike(r"^\p{L}{2}$") & ~F.col("code").isin(*noise)).groupBy("code").agg(F.count("*").alias("n_lines"))


def page_lines(pages: DataFrame, codes: list[str], markers: tuple[tuple[str, str], ...] = MARKERS) -> DataFrame:
    """RE-4, FI-10, JO-12: (doc, page_no, line_no, concept_line, code, rest) of lines that belong to a language.

    A page whose first line has a code as a word, or a marker, is no concept page and is skipped. The first line is the concept's.
    """
    lines = F.split("text", "\n")
    first = F.get(lines, F.lit(0))
    in_first = F.exists(F.split(first, f"{T.BLANK}+"), lambda w: w.isin(*codes))
    for marker, _ in markers:
        in_first = in_first | F.contains(first, F.lit(marker))
    rows = pages.where(~F.coalesce(in_first, F.lit(False))).select("doc", "page_no", first.alias("concept_line"), F.posexplode(lines).alias("line_no", "line"))
    rows = rows.where("line_no > 0").withColumn("line", T.strip(F.col("line"))).withColumn("word", F.regexp_extract("line", FIRST_WORD, 1))
    code = F.when(F.col("word").isin(*codes), F.col("word"))
    for marker, to in markers:
        code = code.when(F.startswith("word", F.lit(marker)), F.lit(to))
    rest = T.strip(F.substring(F.col("line"), F.length("word") + 1, F.length("line")))
    return rows.select("doc", "page_no", "line_no", "concept_line", code.alias("code"), rest.alias("rest")).where("code is not null")


def wordlist(pages: DataFrame, codes: list[str], markers: tuple[tuple[str, str], ...] = MARKERS) -> DataFrame:
    """S1: long forms (doc, page_no, pos, concept, lang, form). Of a page's lines for one language the last counts (Q-3)."""
    rows = page_lines(pages, codes, markers).groupBy("doc", "page_no", "code").agg(F.max_by("rest", "line_no").alias("rest"), F.first("concept_line").alias("head"))
    forms = rows.select("doc", "page_no", T.clean_concept(F.col("head")).alias("concept"), F.col("code").alias("lang"), F.posexplode(T.clean_forms(F.col("rest"))).alias("pos", "form"))
    return forms.where("concept <> ''")


def with_position(forms: DataFrame) -> DataFrame:
    """WI-4: forms (row_idx, concept_id, lang, form) with pos, the ordinal among a language's synonyms of a concept, from 0."""
    order = Window.partitionBy("concept_id", "lang").orderBy("row_idx")
    return forms.withColumn("pos", (F.row_number().over(order) - 1).cast("long"))


def to_wide(forms: DataFrame, langs: list[str]) -> DataFrame:
    """RE-2, PR-4: a row for each (concept_id, pos), a column for each language in code point order. ID is renamed ID_LANG (Q-1)."""
    wide = forms.groupBy("concept_id", "pos").pivot("lang", sorted(langs)).agg(F.first("form"))
    return wide.withColumnRenamed("ID", "ID_LANG") if "ID" in langs else wide


def languages_of(wide: DataFrame, keys: tuple[str, ...] = ("concept_id", "pos")) -> list[str]:
    """PR-1."""
    return [c for c in wide.columns if c not in keys]


def to_long(wide: DataFrame, keys: tuple[str, ...] = ("concept_id", "pos"), exclude: tuple[str, ...] = ()) -> DataFrame:
    """RE-1, FI-13, PR-3: (keys, lang, lang_ord, form) without blank forms; excluded languages left out."""
    langs = [c for c in languages_of(require(wide, *keys), keys) if c not in exclude]
    place = F.create_map(*(x for k, c in enumerate(langs) for x in (F.lit(c), F.lit(k))))
    rows = wide.select(*keys, *langs).unpivot(list(keys), langs, "lang", "form").where(T.non_blank(F.col("form")))
    return rows.select(*keys, "lang", F.element_at(place, F.col("lang")).alias("lang_ord"), "form")


def with_ids(rows: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """WI-3: sequential ids of emitted rows."""
    return numbered(rows, order, name)


def coverage_filter(forms: DataFrame, min_langs: int = 0, remove: tuple[str, ...] = ()) -> DataFrame:
    """S2: (new_id, concept_id, pos, lang, form) of concepts that enough languages have.

    forms: (concept_id, pos, lang, form), a wide row being (concept_id, pos). Languages are removed first. Coverage of a
    concept is the largest number of languages in one of its rows (Q-4). Blank forms, and rows of nothing else, go.
    new_id numbers the remaining concepts in the order of concept_id, which is their order in the table.
    """
    rows = kept(forms.where(T.non_blank(F.col("form")) & ~F.coalesce(F.col("lang").isin(*remove), F.lit(False))), "covered")
    per_row = rows.groupBy("concept_id", "pos").agg(F.count("*").alias("n"))
    keep = per_row.groupBy("concept_id").agg(F.max("n").alias("n")).where(F.col("n") >= min_langs).select("concept_id")
    ids = numbered(keep, ["concept_id"], "new_id")
    return rows.join(ids, "concept_id").select("new_id", "concept_id", "pos", "lang", "form")


def coverage_stats(forms: DataFrame) -> DataFrame:
    """AG-3, AG-4, AG-5: one row about languages per wide row and rows per concept."""
    rows = forms.where(T.non_blank(F.col("form"))).groupBy("concept_id", "pos").agg(F.count("*").alias("n"))
    rows = kept(rows, "wide_rows")  # read twice
    a = rows.agg(F.min("n").alias("min_langs"), F.max("n").alias("max_langs"), F.round(F.avg("n"), 6).alias("mean_langs"), F.median("n").alias("median_langs"), F.count("*").alias("n_rows"))
    per = rows.groupBy("concept_id").agg(F.count("*").alias("k"))
    b = per.agg(F.count("*").alias("n_concepts"), F.count_if(F.col("k") > 1).alias("n_with_synonyms"), F.max("k").alias("most_synonyms"))
    return a.withColumn("_", F.lit(1)).join(b.withColumn("_", F.lit(1)), "_").drop("_")


def concept_ids(forms: DataFrame) -> DataFrame:
    """WI-1: (concept, first, new_id)."""
    return first_seen(forms, "concept", "row_idx", "new_id")


def union_pages(*parts: DataFrame) -> DataFrame:
    """SE-2: rows of wide tables with differing columns."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def drop_columns(wide: DataFrame, names: list[str]) -> tuple[DataFrame, list[str], list[str]]:
    """PR-2: (wide without the columns, names found, names missing); names are stripped."""
    names = [n.strip() for n in names]
    found = [n for n in names if n in wide.columns]
    return wide.drop(*found), found, [n for n in names if n not in wide.columns]


def any_form(langs: list[str]) -> Column:
    """FI-2 on wide rows: some language has a form."""
    return F.exists(F.array(*(F.col(c) for c in langs)), T.non_blank)


def preview(concepts: DataFrame, n: int) -> DataFrame:
    """SO-1, LI-1: the first n of concepts (concept, concept_id, row_idx) with their place, by concept_id if any row has one, nulls last, and by row."""
    order = [F.col("concept_id").asc_nulls_last(), F.col("row_idx")]
    return concepts.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))  # n rows
