"""The registered queries on the smallest given tables, as a whole: columns, contracts, SQL where there is some, plain loops elsewhere."""

import glob
import hashlib
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import pytest
from wordloom.llm import queries as Q

from .fixtures import tokens
from .test_join_and_contain import brute_components
from .test_models import filled, held

DIR = os.environ.get("TESTDATA_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet").collect()


def run(spark, name):
    return Q.queries()[name](spark, DIR)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df, sql = run(spark, name), con.sql(Q.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(sql.columns)
    places = [sql.columns.index(c) for c in order]
    assert sorted(repr(tuple(r[c] for c in order)) for r in df.collect()) == sorted(repr(tuple(r[k] for k in places)) for r in sql.fetchall())


def test_mix(spark, docs):
    found = {r.doc_id: r for r in run(spark, "op2_mix_sources").collect()}
    sizes, taken = Counter(), Counter()
    for r in docs:
        sizes[r.source] += len(tokens(r.text))
    target = filled(sizes)
    for r in docs:
        x = found[r.doc_id]
        assert (x.size, x.source_size) == (len(tokens(r.text)), sizes[r.source]) and math.isclose(x.target, target[r.source], rel_tol=1e-9) and 0 <= x.taken <= 3 * x.size
        taken[r.source] += x.taken
    least = {s: min((len(tokens(r.text)) for r in docs if r.source == s and tokens(r.text)), default=0) for s in sizes}
    most = {s: max((len(tokens(r.text)) for r in docs if r.source == s), default=0) for s in sizes}
    assert len(found) == len(docs) and all(abs(taken[s] - t) <= 0.01 * t + max(least[s], most[s] - (sizes[s] - most[s])) for s, t in target.items())


def test_joins(spark, docs):
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in run(spark, "op3_ngram_jaccard_join").collect()), key=repr)
    assert found == brute_components([(r.doc_id, r.text) for r in docs], 3, 90)


def test_languages(spark, docs):
    found = {r.doc_id: r for r in run(spark, "op4_language_id").collect()}
    assert len(found) == len(docs)
    known = {r.lang for r in docs if r.lang is not None and not held(r.doc_id, 4, 2)}
    right = []
    for r in docs:
        x = found[r.doc_id]
        letters = bool(r.text) and any(c.isalpha() for c in r.text)
        assert x.held_out == held(r.doc_id, 4, 2) and 0 <= x.score <= 1 and (x.lang_pred in known if letters else x.lang_pred == "und")
        if x.held_out and r.lang and letters:
            right.append(x.lang_pred == r.lang)
    assert sum(right) >= 0.95 * len(right) > 0


def test_scores(spark, docs):
    count = Counter()
    for r in docs:
        if not held(r.doc_id, 5, 1):
            count.update([*tokens(r.text), "end"])
    n, v = sum(count.values()), len(count)
    own, base, out = [0.0, 0.0], [0.0, 0.0], {r.doc_id: r for r in run(spark, "op5_pitman_yor").collect()}
    for r in docs:
        w, x = [*tokens(r.text), "end"], out[r.doc_id]
        expected = sum(math.log10((count[k] + 0.5) / (n + 0.5 * (v + 1))) for k in w)
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held(r.doc_id, 5, 1), len(w), sum(count[k] > 0 for k in w), n) and math.isclose(x.base_score, expected, rel_tol=1e-9)
        own[x.held_out] += x.score
        base[x.held_out] += x.base_score
    assert len(out) == len(docs) and own[True] > base[True] and own[False] > base[False]


def test_urls(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{DIR}/pages.parquet").select("page_id", "url").collect()}
    found = run(spark, "op8_url_filter").collect()
    rules = {"org/": ("org", "/", "allow"), "example.org/es/": ("example.org", "/es/", "block"), "example.org/en/1": ("example.org", "/en/1", "block"), "com/fr/": ("com", "/fr/", "allow"), "com/de/": ("com", "/de/", "block")}
    assert len(found) == len(pages)
    for r in found:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", pages[r.page_id] or "")
        host, path = (m[1].lower() if m[1].isascii() else m[1], m[2]) if m else ("", "")
        fits = [k for k, (h, p, _) in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, key=len, default=None)
        assert (r.host, r.path, r.rule) == (host, path, rule) and (r.verdict == rules[rule][2] if rule else r.verdict in ("allow", "block"))


def test_quality(spark, docs):
    labels = {}
    for r in spark.read.parquet(f"{DIR}/labels.parquet").collect():
        labels.setdefault(r.doc_id, []).append(r.quality)
    found = run(spark, "op9_quality").collect()
    assert len(found) == len(docs)
    for r in found:
        assert r.trusted == (min(labels.get(r.doc_id, [0])) == 1) and r.perplexity > 1 and r.keep == (r.threshold is None or r.perplexity <= r.threshold)
    assert sum(r.keep for r in found if r.trusted) >= 0.9 * sum(r.trusted for r in found)


def test_streams(spark, docs):
    found = {r.doc_id: r for r in run(spark, "op10_transport_stream").collect()}
    assert len(found) == len(docs)
    for r in docs:
        text, x = (r.text or "").encode(), found[r.doc_id]
        payload = text + b"\0" * (-len(text) % 64 or (0 if text else 64))
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert x.media_bytes % 188 == 0 and re.fullmatch("[0-9a-f]{64}", x.media_sha256)
