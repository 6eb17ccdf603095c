"""URL filter: host and path rules, and logistic regression on hashed character n-grams where none fits.

Everything is DataFrame functions. The regression is trained from a small labelled table by
gradient steps, each an aggregate over the table's n-grams; weights, a vector of BUCKETS
numbers, go into the expression as a constant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import kept

BUCKETS = 2048
GRAM = 3
STEPS = 30
RATE = 4.0
RIDGE = 1e-3

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

# The labelled table: fixed values, (block 1 or allow 0, first words of hosts, second words, words of paths), from which labelled_urls makes URLs.
_WORDS = (
    (
        1,
        "casino poker slots bets lottery bingo roulette jackpot pills viagra pharma replica loans payday crypto doubler adult cams escort dating warez cracked keygen torrent clickbait miracle diet spam".split(),
        "win free hot cheap lucky fast easy bonus farm deals promo now club vip xxx".split(),
        "bonus win-now click jackpot signup?aff= free-spins order-now claim hot-deals download-crack xxx-pics promo redirect offer".split(),
    ),
    (
        0,
        "library news weather school museum recipes university hospital theatre garden science history travel council archive journal music sports bank police railway radio church village forum hobby opera".split(),
        "city open national local public royal central data county daily online new north old first".split(),
        "about article archive contact events research education timetable reports gallery policy members books 2024/05".split(),
    ),
)
_HOSTS = ("{a}-{b}.{t}", "www.{a}{b}.{t}", "{b}.{a}.{t}", "{a}{n}.{t}")
_ENDS = ("com", "net", "org", "info", "biz", "co.uk", "de", "io")
_PATHS = ("/{p}", "/{p}/{n}", "/{p}.html", "/en/{p}/{a}-{n}", "/{b}/{p}?id={n}")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): the small labelled table, a few hundred URLs of hosts and paths of many makes; both labels have all makes and endings."""
    rows = []
    for label, first, second, paths in _WORDS:
        for k in range(len(first) * 8):
            words = {"a": first[k % len(first)], "b": second[(k * 7 + k // len(first)) % len(second)], "p": paths[(k * 5 + 3) % len(paths)], "n": k * 37 % 991}
            url = _HOSTS[k // 3 % len(_HOSTS)].format(t=_ENDS[k % len(_ENDS)], **words) + _PATHS[k // 2 % len(_PATHS)].format(**words)
            rows.append((f"http{'s' if k % 3 else ''}://{url}", label))
    return spark.createDataFrame(rows, "url string, label int")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """(host in lower case, path): what is after the first `://`; both empty without it or for null."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def _buckets(text: Column, mark: str) -> Column:
    padded = F.concat(F.lit("^"), text, F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - GRAM + 1, F.lit(1))), lambda i: F.substring(padded, i, GRAM))
    return F.transform(grams, lambda g: F.pmod(F.xxhash64(F.lit(mark), g), F.lit(BUCKETS)).cast("int"))


def features(host: Column, path: Column) -> Column:
    """Buckets of the n-grams of host and path; host and path n-grams differ."""
    return F.concat(_buckets(host, "h"), _buckets(path, "p"))


def _margin(weights: list[float], grams: Column) -> Column:
    vector = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded to a constant
    total = F.aggregate(grams, F.lit(0.0), lambda acc, g: acc + F.element_at(vector, g + 1))
    return total / F.sqrt(F.size(grams)) + weights[BUCKETS]


def train(labelled: DataFrame) -> list[float]:
    """Weights of the buckets and, last, the intercept. labelled: (url, label), a small table; nulls teach nothing."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.where("url is not null and label is not null").select(features(host, path).alias("grams"), F.col("label").cast("double").alias("label"))
    rows = kept(rows, "labelled")
    weights, n = [0.0] * (BUCKETS + 1), rows.count()
    for _ in range(STEPS if n else 0):
        p = 1 / (1 + F.exp(-_margin(weights, F.col("grams"))))
        off = rows.select("grams", (p - F.col("label")).alias("off"))
        parts = off.select(F.explode(F.concat("grams", F.array(F.lit(BUCKETS)))).alias("b"), (F.col("off") / F.sqrt(F.size("grams"))).alias("g"), "off")
        slope = parts.groupBy("b").agg(F.sum(F.when(F.col("b") == BUCKETS, F.col("off")).otherwise(F.col("g"))).alias("g"))
        step = {r.b: r.g for r in slope.collect()}  # BUCKETS + 1 rows at most
        weights = [round(w - RATE * (step.get(b, 0.0) / n + RIDGE * w), 12) for b, w in enumerate(weights)]
    return weights


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is looked at first in the end
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def judged(pages: DataFrame, labelled: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of pages (page_id, url).

    score: the regression's probability of block; verdict: the rule's, else block at a score of 0.5 or more. A null
    url, or one without `://`, has empty host and path and is judged by the regression. Null ids stay null, rows given twice
    come out twice, other columns are ignored; no rows in, none out.
    """
    weights = train(labelled)
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    score = 1 / (1 + F.exp(-_margin(weights, features(F.col("host"), F.col("path")))))
    rows = rows.select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled"), F.round(score, 9).alias("score"))
    return rows.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score"
    )
