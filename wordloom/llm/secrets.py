"""Secret scan over a trigram inverted index, in DataFrame functions alone.

From each rule's regular expression a Boolean query over lower-case trigrams is derived: what
every match must contain. The index posts the queries' trigrams by text; a text's postings are
intersected by the query, and only candidates are searched with the expression. A rule
whose expression has no mandatory trigram is searched in every text.
"""

from __future__ import annotations

import re._parser as sre
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import columns_of, looked_up


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group with the secret
    least: int = 0  # characters that the group must have
    any_case: bool = False


#: The order is that of kinds in results. The first three are the base rules.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abps]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[0-9A-Za-z_-]+", 0, 39),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 0),
)
BASE = ("assign", "access", "hex")
RUN = 256  # matches whose places are counted up together
_MOST = 64  # strings that a part of an expression may stand for, to be followed one by one


# A query is True, a trigram, ("and", queries) or ("or", queries).
def _join(op: str, queries: list) -> object:
    unit = op == "and"
    if op == "or" and any(q is True for q in queries):
        return True
    flat = list(dict.fromkeys(q for q in queries if q is not True))
    if not flat:
        return unit or True
    return flat[0] if len(flat) == 1 else (op, tuple(flat))


def _contains(strings: set[str]) -> object:
    """One of the strings is there. What another string's trigrams imply is left out."""
    sets = {s: {s[i : i + 3] for i in range(len(s) - 2)} for s in sorted(strings)}
    fewest = [s for s in sets if not any(sets[t] < sets[s] or sets[t] == sets[s] and t < s for t in sets)]
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in fewest])


def _part(node: tuple) -> tuple[set[str] | None, object]:
    """(the strings that the node may stand for, or None if too many; what any match of it contains)."""
    kind, value = node
    if kind is sre.LITERAL:
        return {chr(value).lower()}, True
    if kind is sre.IN and len(value) <= 8 and all(k is sre.LITERAL for k, _ in value):
        return {chr(v).lower() for _, v in value}, True
    if kind is sre.SUBPATTERN:
        return _sequence(value[-1])
    if kind is sre.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        query = _join("or", [_join("and", [q, _contains(s) if s else True]) for s, q in parts])
        exact = all(s is not None and q is True for s, q in parts)
        strings = set().union(*(s for s, _ in parts)) if exact else None
        return (strings, True) if strings is not None and len(strings) <= _MOST else (None, query)
    if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = value
        strings, query = _sequence(inner)
        if (low, high) == (0, 1) and strings is not None and query is True:
            return strings | {""}, True
        return None, _join("and", [query, _contains(strings) if strings else True]) if low else True
    return None, True


def _sequence(nodes) -> tuple[set[str] | None, object]:
    """As _part, for nodes in a row: runs of exact strings are multiplied out, and closed where a part isn't exact."""
    run, queries, exact = {""}, [], True
    for node in nodes:
        strings, query = _part(node)
        if strings is not None and len(run) * len(strings) <= _MOST:
            run = {a + b for a in run for b in strings}
            queries.append(query)
            continue
        queries += [_contains(run), query]
        run, exact = (strings, False) if strings is not None else ({""}, False)
    if exact and all(q is True for q in queries):
        return run, True
    return None, _join("and", [*queries, _contains(run)])


def trigram_query(pattern: str) -> object:
    """What trigrams a text must have, in lower case, for the expression to match in it; True if nothing follows."""
    strings, query = _sequence(sre.parse(pattern))
    return _contains(strings) if strings is not None else query


def _grams(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(_grams, query[1]))


def _holds(query: object, posted: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(posted, query)
    out = None
    for q in query[1]:
        c = _holds(q, posted)
        out = c if out is None else (out & c if query[0] == "and" else out | c)
    return out


def _java(rule: Rule) -> str:
    return ("(?i)" if rule.any_case else "") + rule.pattern


def spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, order, end, kind>> of a rule's matches, leftmost and non-overlapping, in code points.

    The pieces between matches and the matches themselves give all positions in one pass.
    """
    pieces, found = F.split(text, _java(rule), -1), F.regexp_extract_all(text, F.lit(_java(rule)), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(_java(rule)), F.lit(rule.group)) if rule.group else found
    parts = F.arrays_zip(pieces.alias("piece"), found.alias("found"), groups.alias("group"))
    span = "struct<start:int,order:int,end:int,kind:string>"
    start = lambda acc, x: acc["at"] + F.length(x["piece"])
    end = lambda acc, x: start(acc, x) + F.coalesce(F.length(x["found"]), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        one = F.struct(start(acc, x).alias("start"), F.lit(order).alias("order"), end(acc, x).alias("end"), F.lit(rule.kind).alias("kind"))
        keep = x["found"].isNotNull() & (F.length(x["group"]) >= rule.least)
        return F.struct(
            end(acc, x).cast("int").alias("at"),
            F.when(keep, F.concat(acc["spans"], F.array(one).cast(f"array<{span}>"))).otherwise(acc["spans"]).alias("spans"),
        )

    def moved(acc: Column, x: Column) -> Column:
        far = F.transform(x["spans"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["order"].alias("order"), (s["end"] + acc["at"]).alias("end"), s["kind"].alias("kind")))
        return F.struct((acc["at"] + x["at"]).cast("int").alias("at"), F.concat(acc["spans"], far.cast(f"array<{span}>")).alias("spans"))

    # matches are counted up in runs of RUN and the runs then put together, so that no array grows by one match at a time
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("spans"))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / RUN).cast("int")), lambda k: F.aggregate(F.slice(parts, k * RUN + 1, RUN), empty, step))
    return F.aggregate(runs, empty, moved, lambda acc: acc["spans"])


def _own_names(docs: DataFrame) -> str:
    """A prefix that no column of docs has."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix


def posted(texts: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index of the given trigrams: (gram, h, n), a row for each distinct text (h, n, text) that has one in any case."""
    listed = F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(F.col("low"), g))
    rows = texts.select("h", "n", F.lower("text").alias("low")).select("h", "n", F.explode(listed).alias("gram"))
    return rows.select("gram", "h", "n").distinct()


def candidates(texts: DataFrame, queries: dict[str, object]) -> DataFrame:
    """(h, n, a column for each kind): the texts whose postings answer the query of some kind."""
    index = posted(texts, sorted(set().union(*map(_grams, queries.values()))))
    index = index.groupBy("h", "n").agg(F.collect_set("gram").alias("grams"))  # a few dozen trigrams at most
    flags = [_holds(q, F.col("grams")).alias(kind) for kind, q in queries.items()]
    return index.select("h", "n", *flags).where(" or ".join(queries))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, out: str = "_spans") -> DataFrame:
    """docs with out: array<struct<start, order, end, kind>> of all secrets in text, by start, then order of rules.

    Positions are code points, ends are exclusive. A null or empty text has no spans. Every row and column of docs
    stays, whatever the keys and names. A text's postings and a candidate's rules stand under the text's hash and length;
    texts that happen to share both are merely searched once more than they need be.
    """
    own = _own_names(docs)
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {kind: q for kind, q in queries.items() if q is not True}
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumns({f"{own}t": text, f"{own}h": F.xxhash64(text), f"{own}n": F.octet_length(text)})
    found = candidates(rows.select(F.col(f"{own}t").alias("text"), F.col(f"{own}h").alias("h"), F.col(f"{own}n").alias("n")), indexed)
    found = looked_up(found.select([F.col(c).alias(f"{own}is_{c}") for c in found.columns]), "candidates")
    rows = rows.join(found, (F.col(f"{own}h") == F.col(f"{own}is_h")) & (F.col(f"{own}n") == F.col(f"{own}is_n")), "left")
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    every = []
    for order, rule in enumerate(rules):
        on = F.col(f"{own}is_{rule.kind}") if rule.kind in indexed else F.col(f"{own}t").rlike(_java(rule) if rule.least < 2 else _long(rule))
        every.append(F.when(on, spans(F.col(f"{own}t"), rule, order)).otherwise(none))
    rows = rows.withColumn(f"{own}out", F.array_sort(F.flatten(F.array(*every))))
    return rows.select(*columns_of(docs), F.col(f"{own}out").alias(out))


def _long(rule: Rule) -> str:
    """An expression that finds something wherever a long enough match is: a class repeated as often."""
    if rule.pattern.startswith("[") and rule.pattern.endswith("]+"):
        return f"{rule.pattern[:-1]}{{{rule.least}}}"
    return _java(rule)


def listed(spans_: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def secrets_found(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row of docs (doc_id, text); see scan_secrets."""
    found = scan_secrets(docs.select("doc_id", "text"))
    base = F.filter("_spans", lambda s: s["order"] < len(BASE))
    count = lambda k: F.size(F.filter("_spans", lambda s: s["order"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("_spans")).alias("spans"),
    )


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every secret in text replaced by the mark; overlapping spans get one mark. Null texts stay null."""
    own = _own_names(docs)
    found = scan_secrets(docs, out=f"{own}spans")
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"),
        )

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    new = F.aggregate(f"{own}spans", empty, step, rest)
    return found.withColumn("text", F.when(F.size(f"{own}spans") > 0, new).otherwise(F.col("text"))).select(columns_of(docs))


def secrets_sql() -> str:
    """DuckDB SQL of secrets_found over documents."""
    arms = []
    for order, rule in enumerate(RULES):
        pattern = _java(rule).replace("'", "''")
        arms.append(f"""
  SELECT r, {order} AS k, '{rule.kind}' AS kind, string_split_regex(t, '{pattern}') AS p,
    regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS g, {rule.least} AS least FROM d""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
a AS ({' UNION ALL '.join(arms)}),
b AS (SELECT r, k, kind, p, m, g, least, unnest(range(1, len(m) + 1)) AS i FROM a),
c AS (
  SELECT r, k, kind, length(m[i]) AS n,
    list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
  FROM b WHERE length(g[i]) >= least
),
e AS (
  SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, k) FILTER (k < 3) AS base,
    string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, k) AS spans
  FROM c GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN e USING (r)
"""
