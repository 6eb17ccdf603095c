"""The given tables in the shapes of the domain, as DataFrames and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.unicode import nfd

SOURCES = [f"src{k}" for k in range(20)]
CODES = ["it", "as", "in", "ti", "el", "as", "le", "en", "un", "la", "de", "th"]
MARKERS = (("Than", "TH"), ("Ñ", "NY"))
#: What the letters with marks in documents decompose to: (composed, letter, mark's code point).
MARKED = [
    ("è", "e", 0x300), ("é", "e", 0x301), ("ê", "e", 0x302), ("ç", "c", 0x327), ("É", "E", 0x301), ("È", "E", 0x300), ("Ê", "E", 0x302), ("ö", "o", 0x308), ("ä", "a", 0x308), ("ü", "u", 0x308),
    ("Ä", "A", 0x308), ("Ö", "O", 0x308), ("Ü", "U", 0x308), ("ó", "o", 0x301), ("í", "i", 0x301), ("ñ", "n", 0x303), ("Ç", "C", 0x327), ("Ó", "O", 0x301), ("Ñ", "N", 0x303), ("Í", "I", 0x301),
    ("á", "a", 0x301), ("ú", "u", 0x301), ("à", "a", 0x300), ("ù", "u", 0x300), ("â", "a", 0x302), ("î", "i", 0x302), ("ô", "o", 0x302), ("û", "u", 0x302),
]
ACCENTS = "".join(c for c, _, _ in MARKED)
PRIORITY_TONES = {"1-URGENT": "H", "2-HIGH": "L", "3-MEDIUM": "M", "4-NOT SPECIFIED": "R", "5-LOW": "F"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cogsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, concept, doculect, form, cogid): parts; a brand is a set."""
    cogid = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long").alias("cogid")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("concept"), F.col("p_size").alias("doculect"), F.col("p_name").alias("form"), cogid)


COGSETS = "SELECT p_partkey AS id, p_type AS concept, p_size AS doculect, p_name AS form, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS cogid FROM part"


def languages(spark: SparkSession, sf_dir: str) -> list[str]:
    """The sources of documents in code point order; each is a column of wide tables."""
    return sorted(r.source for r in table(spark, sf_dir, "documents").select("source").where("source is not null").distinct().collect())


PLACE = 1 << 24  # of a word in its document, at most


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_idx, concept_id, concept, lang, form): the distinct words of the documents of one length and source, where they first stand; the length is the concept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", F.posexplode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("at", "word"))
    rows = docs.groupBy(F.col("n_chars").alias("concept_id"), F.col("source").alias("lang"), F.lower("word").alias("form")).agg(F.min(F.col("doc_id") * PLACE + F.col("at")).alias("row_idx"))
    return rows.select("row_idx", "concept_id", F.concat(F.lit("L"), "concept_id").alias("concept"), "lang", "form")


FORMS = rf"""SELECT min(doc_id * {PLACE} + nth) AS row_idx, n_chars AS concept_id, 'L' || n_chars AS concept, source AS lang, lower(word) AS form FROM (
  SELECT doc_id, n_chars, source, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS nth FROM (SELECT *, regexp_extract_all(text, '\p{{L}}+') AS ws FROM documents)) GROUP BY n_chars, source, lower(word)"""
POSITIONED = f"SELECT *, row_number() OVER (PARTITION BY concept_id, lang ORDER BY row_idx) - 1 AS pos FROM ({FORMS})"


def lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(concept, lang, form, tokens): the distinct part names of a brand and size; a brand is a language, a size a concept."""
    part = table(spark, sf_dir, "part").select(F.col("p_size").cast("string").alias("concept"), F.col("p_brand").alias("lang"), F.lower("p_name").alias("form")).distinct()
    return part.withColumn("tokens", T.tokens(F.col("form")))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, page_no, text): documents; ten to a book."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.floor(F.col("doc_id") / 10).alias("doc"), (F.col("doc_id") % 10).alias("page_no"), "text")


PAGES = "SELECT doc_id // 10 AS doc, doc_id % 10 AS page_no, text FROM documents"


def meanings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, score): distinct part names."""
    part = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"), F.min_by("p_size", "p_partkey").alias("size"))
    return part.select("id", "name", F.when(F.col("size") % 10 != 0, F.col("size") / 50).alias("score"))


MEANINGS = "SELECT id, name, CASE WHEN size % 10 <> 0 THEN size / 50.0 END::DOUBLE AS score FROM (SELECT p_name AS name, min(p_partkey) AS id, arg_min(p_size, p_partkey) AS size FROM part GROUP BY p_name)"


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_idx, concept_id, concept): part names as one finds concepts written."""
    k, n, t = F.col("p_partkey") % 7, F.col("p_name"), F.lower("p_type")
    written = (
        F.when(k == 0, F.concat(F.lit("The "), n, F.lit(" (of parts)"))).when(k == 1, F.concat(F.lit("to "), n)).when(k == 2, F.concat(F.upper(n), F.lit("s")))
        .when(k == 3, F.concat(n, F.lit(" / "), t)).when(k == 4, F.concat(t, F.lit(" or "), n)).when(k == 5, F.concat(F.replace(n, F.lit("o"), F.lit("u")), F.lit("x"))).otherwise(F.concat(t, F.lit("."), F.lit(" thing")))
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_idx"), (F.col("p_partkey") % 1000).alias("concept_id"), written.alias("concept"))


CONCEPTS = """SELECT p_partkey AS row_idx, p_partkey % 1000 AS concept_id, CASE p_partkey % 7 WHEN 0 THEN 'The ' || p_name || ' (of parts)' WHEN 1 THEN 'to ' || p_name
  WHEN 2 THEN upper(p_name) || 's' WHEN 3 THEN p_name || ' / ' || lower(p_type) WHEN 4 THEN lower(p_type) || ' or ' || p_name WHEN 5 THEN replace(p_name, 'o', 'u') || 'x'
  ELSE lower(p_type) || '. thing' END AS concept FROM part"""
DISTINCT = f"SELECT concept, arg_min(concept_id, row_idx) AS concept_id, min(row_idx) AS row_idx FROM ({CONCEPTS}) GROUP BY concept"


def accented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(form, n): the distinct words of documents that have a letter with a mark."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("form"))
    return words.where(F.col("form").rlike(f"[{ACCENTS}]")).groupBy("form").agg(F.count("*").alias("n"))


ACCENTED = rf"SELECT form, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\p{{L}}+')) AS form FROM documents) WHERE regexp_matches(form, '[{ACCENTS}]') GROUP BY form"


def nfd_sql(x: str) -> str:
    for c, letter, mark in MARKED:
        x = f"replace({x}, '{c}', '{letter}' || chr({mark}))"
    return x


def nfc_sql(x: str) -> str:
    for c, letter, mark in MARKED:
        x = f"replace({x}, '{letter}' || chr({mark}), '{c}')"
    return x


def twice_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(form, nfd): the words of accented, decomposed, with a second mark after each acute, grave or circumflex."""
    twice = F.regexp_replace(F.regexp_replace(nfd(F.col("form")), "([\\x{300}\\x{302}])", "$1\u0301"), "(?<![\\x{300}\\x{302}])\u0301", "\u0301\u0300")
    return accented(spark, sf_dir).select("form", twice.alias("nfd"))


TWICE_MARKED = f"""SELECT form, replace(replace(replace(replace({nfd_sql('form')}, chr(769), '#'), chr(768), chr(768) || chr(769)), chr(770), chr(770) || chr(769)), '#', chr(769) || chr(768)) AS nfd FROM ({ACCENTED})"""  # words are letters, so none has a #


WORDS = 1_000_000  # of a customer, at most


def toned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, concept, lang, cogid, pattern): a word of four syllables at most for every four orders of a customer, by date; their priorities are its tones."""
    orders = table(spark, sf_dir, "orders")
    tone = F.element_at(F.create_map(*(F.lit(x) for kv in PRIORITY_TONES.items() for x in kv)), F.col("o_orderpriority"))
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    tones = orders.select("o_custkey", nth.alias("nth"), tone.alias("tone")).withColumn("word", F.floor(F.col("nth") / 4))
    patterns = tones.groupBy("o_custkey", "word").agg(T.pattern(F.transform(F.array_sort(F.collect_list(F.struct("nth", "tone"))), lambda x: x["tone"])).alias("pattern"))
    rows = table(spark, sf_dir, "customer").join(patterns, F.col("c_custkey") == F.col("o_custkey"))
    cogid = (F.col("c_nationkey") * 5 + F.length("c_mktsegment") % 5).cast("long")
    return rows.select((F.col("c_custkey") * WORDS + F.col("word")).cast("long").alias("id"), F.col("c_mktsegment").alias("concept"), F.col("c_nationkey").alias("lang"), cogid.alias("cogid"), "pattern")


TONED = f"""SELECT (c_custkey * {WORDS} + word)::BIGINT AS id, c_mktsegment AS concept, c_nationkey AS lang, (c_nationkey * 5 + length(c_mktsegment) % 5)::BIGINT AS cogid, pattern FROM customer JOIN (
  SELECT o_custkey, (nth - 1) // 4 AS word, string_agg(CASE o_orderpriority WHEN '1-URGENT' THEN 'H' WHEN '2-HIGH' THEN 'L' WHEN '3-MEDIUM' THEN 'M' WHEN '4-NOT SPECIFIED' THEN 'R' ELSE 'F' END, '.' ORDER BY nth) AS pattern
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth FROM orders) GROUP BY o_custkey, (nth - 1) // 4) ON c_custkey = o_custkey"""


def attested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(language, concept, cogid): all words of documents by source; a word's length is its concept, its first letters tell its set."""
    words = table(spark, sf_dir, "documents").select(F.col("source").alias("language"), F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    form = F.lower("word")
    return words.select("language", F.concat(F.lit("L"), F.length(form)).alias("concept"), F.substring(form, 1, 2).alias("cogid")).distinct()


ATTESTED = r"SELECT DISTINCT source AS language, 'L' || length(lower(word)) AS concept, substring(lower(word), 1, 2) AS cogid FROM (SELECT source, unnest(regexp_extract_all(text, '\p{L}+')) AS word FROM documents)"


def region_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, newick): a tree text for each region, its nations the inner nodes with a support, their suppliers the tips."""
    n, s = (table(spark, sf_dir, x) for x in ("nation", "supplier"))
    tip = F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.lit(":"), F.format_string("%.5f", F.abs("s_acctbal").cast("double") / 1000))
    tips = s.groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", tip.alias("tip")))), lambda x: x["tip"]), ",").alias("tips"))
    one = F.concat(F.lit("("), "tips", F.lit(")[&posterior="), F.format_string("%.2f", F.col("n_nationkey") % 21 / 20.0), F.lit("]:"), (F.col("n_nationkey") % 5 + 1).cast("string"))
    nations = n.join(tips, F.col("n_nationkey") == F.col("s_nationkey")).select("n_regionkey", F.struct("n_nationkey", one.alias("node")).alias("x"))
    whole = nations.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["node"]), ",").alias("nodes"))
    return whole.select(F.concat(F.lit("region"), F.col("n_regionkey").cast("string")).alias("file"), F.concat(F.lit("("), "nodes", F.lit(");")).alias("newick"))


def supplier_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, parent_id, child_ord, length): root, regions, nations, suppliers."""
    r, n, s = (table(spark, sf_dir, x) for x in ("region", "nation", "supplier"))
    root = spark.range(1).select(F.lit(0).cast("long").alias("node_id"), F.lit(None).cast("long").alias("parent_id"), F.lit(0).cast("long").alias("child_ord"), F.lit(0.0).alias("length"))
    key = lambda c: F.col(c).cast("long")
    regions = r.select((key("r_regionkey") + 1), F.lit(0).cast("long"), key("r_regionkey"), F.lit(1.0))
    nations = n.select((key("n_nationkey") + 1000), (key("n_regionkey") + 1), key("n_nationkey"), (F.col("n_nationkey") % 5 + 1).cast("double"))
    suppliers = s.select((key("s_suppkey") + 100000), (key("s_nationkey") + 1000), key("s_suppkey"), F.abs("s_acctbal") / 1000)
    return root.union(regions).union(nations).union(suppliers)
