"""Each query against its DuckDB SQL on the smallest tables."""

import glob
import math
import os
import re

import duckdb
import pytest
from wordloom.plans import catalogue

DIR = os.environ.get("TESTDATA_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    value = lambda x: None if isinstance(x, float) and math.isnan(x) else round(x, 9) if isinstance(x, float) else x
    return sorted((tuple(value(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    found = plain(df.collect(), df.columns)
    if name in catalogue.SQL:
        sql = duck.sql(catalogue.SQL[name])
        assert sorted(df.columns) == sorted(sql.columns)
        assert found == plain(sql.fetchall(), sql.columns)
    else:
        assert found


def test_matches_equal_brute_force(spark, duck):
    """match_report, review_matches and fuzzy_match against every variant with every meaning."""
    from wordloom.functions.unicode import sequence_ratio
    from wordloom.plans import proxies as X

    variants = duck.sql(f"WITH {catalogue._VARIANTS_SQL} SELECT concept, concept_id, row_idx, variant, o FROM v ORDER BY concept, o").fetchall()
    meanings = duck.sql(f"SELECT * FROM ({X.MEANINGS}) ORDER BY id").fetchall()
    own = {}
    for concept, _, _, variant, _ in variants:
        own.setdefault(concept, []).append(variant)
    expected = {}
    for concept, vs in own.items():
        exact = next(((i, 1.0, "exact") for v in vs for i, n, _ in meanings if n.lower().strip() == v), None)
        ratio = max((2 * min(len(v), len(n)) / (len(v) + len(n)) >= 0.8 and (sequence_ratio(v, n), -k, -i) or (0, 0, 0) for k, v in enumerate(vs) for i, n, _ in meanings), default=(0, 0, 0))
        expected[concept] = exact or ((-ratio[2], round(ratio[0], 9), "fuzzy") if ratio[0] >= 0.8 else (None, 0.0, "no_match"))
    fuzzy = {r.concept: (r.id, round(r.match_score, 9), r.method) for r in catalogue.fuzzy_match(spark, DIR).collect()}
    assert fuzzy == expected
    report = catalogue.match_report(spark, DIR).first()
    count = lambda method: sum(m == method for *_, m in expected.values())
    assert (report.total, report.n_exact, report.n_fuzzy, report.n_unmatched) == (len(expected), count("exact"), count("fuzzy"), count("no_match"))
    reviewed = {r.concept: (r.id, round(r.match_score, 9), r.method) for r in catalogue.review_matches(spark, DIR).collect()}
    decisions = {r.row_idx: r for r in catalogue._decisions(spark, DIR).collect()}
    first = {c: row for c, _, row, _, _ in variants}
    stop = min((k for k, d in decisions.items() if d.action == "q"), default=math.inf)
    by_id, names = {i: n for i, n, _ in meanings}, [(i, n) for i, n, _ in meanings]
    for concept, (i, score, method) in expected.items():
        d = decisions.get(first[concept])
        want = (i, score, method)
        if d and method != "exact" and first[concept] < stop:
            action = d.action.lower()
            if action == "n":
                want = (None, score, "manual_no_match")
            elif action == "s":
                q = d.query.lower()
                hits = [k for k, n in names if (str(k) == q if q.isdigit() else re.search(q, n, re.I))]
                want = (hits[d.selection - 1], 1.0, "manual") if len(hits) >= d.selection else want
            elif action == "" and method == "fuzzy":
                want = (i, score, "fuzzy_accepted")
        assert reviewed[concept] == want and (want[0] is None or want[0] in by_id)
