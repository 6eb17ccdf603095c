"""Operators on small tables with known results."""

import itertools
import random
import time
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from wordloom.functions import newick
from wordloom.operators import cognates as C
from wordloom.operators import lexstat as L
from wordloom.operators import matching as M
from wordloom.operators import numbering as N
from wordloom.operators import patterns
from wordloom.operators import phylo as P
from wordloom.operators import summaries
from wordloom.operators import wordlists as W
from wordloom.operators.linkage import condensed, merge_tree
from wordloom.operators.patterns import Automaton
from wordloom.sources import tables as S
from wordloom.sources.shared import kept

COGNATES = [(1, "A", "L1", "kitten", 1), (2, "A", "L2", "sitting", 1), (3, "A", "L3", "kitten", 1), (4, "A", "L4", "x", 2), (5, "B", "L1", "abc", 3)]


@pytest.fixture(scope="module")
def cognates(spark):
    return spark.createDataFrame(COGNATES, "id long, concept string, doculect string, form string, cogid long")


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_pages_to_wordlist(spark):
    pages = [(1, 6, "1. water (fresh)\nAA béni, bení / beni\nBB [check] mini\nCC -\nAA last wins"), (1, 7, "AA is a code\nAA x"), (1, 2, "AA one\nthe two\nB3 no\n zz three\nAA"), (1, 8, "sun\nKalabari ola\nxx none")]
    df = spark.createDataFrame(pages, "doc long, page_no int, text string")
    assert rows(W.language_codes(df), "code", "n_lines") == [("AA", 2), ("zz", 1)]
    found = W.wordlist(df.where("page_no >= 6"), ["AA", "BB", "CC"])
    assert rows(found, "page_no", "concept", "lang", "pos", "form") == [(6, "WATER", "AA", 0, "last wins"), (6, "WATER", "BB", 0, "mini"), (8, "SUN", "KA", 0, "ola")]


FORMS = [(1, 1, "WATER", "AA", "béni"), (2, 1, "WATER", "AA", "bení"), (3, 1, "WATER", "BB", "mini"), (4, 4, "SUN", "AA", "ɛrɛ̃"), (5, 9, "EYE", "CC", " "), (6, 9, "EYE", "BB", None)]


def test_coverage_and_shape(spark):
    forms = W.with_position(spark.createDataFrame(FORMS, "row_idx long, concept_id long, concept string, lang string, form string"))
    assert rows(W.coverage_filter(forms, 2), "new_id", "concept_id", "pos", "lang") == [(1, 1, 0, "AA"), (1, 1, 0, "BB"), (1, 1, 1, "AA")]
    assert rows(W.coverage_filter(forms), "new_id", "concept_id") == [(1, 1), (1, 1), (1, 1), (2, 4)]
    assert rows(W.coverage_filter(forms, 0, ("AA",)), "lang") == [("BB",)]
    wide = W.to_wide(forms, ["BB", "AA", "ID"])
    assert wide.columns == ["concept_id", "pos", "AA", "BB", "ID_LANG"]
    long = W.with_ids(W.to_long(wide, exclude=("ID_LANG",)), ["concept_id", "pos", "lang_ord"])
    assert rows(long, "id", "concept_id", "pos", "lang", "form") == [(1, 1, 0, "AA", "béni"), (2, 1, 0, "BB", "mini"), (3, 1, 1, "AA", "bení"), (4, 4, 0, "AA", "ɛrɛ̃")]
    stats = W.coverage_stats(forms).first()
    assert (stats.min_langs, stats.max_langs, stats.n_concepts, stats.n_with_synonyms, stats.most_synonyms) == (1, 2, 2, 1, 2)
    assert rows(W.concept_ids(forms), "concept", "new_id") == [("EYE", 3), ("SUN", 2), ("WATER", 1)]
    left, found, missing = W.drop_columns(wide, [" AA ", "ZZ"])
    assert (found, missing) == (["AA"], ["ZZ"]) and "AA" not in left.columns
    with pytest.raises(ValueError, match="missing columns: pos"):
        W.to_long(wide.drop("pos"))


def test_numbers_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(N, "ROWS", 10)
    df = spark.range(100).select((F.col("id") * 7 % 50).alias("x"), "id")
    found = [r.n for r in N.numbered(df, ["x", "id"], "n").orderBy("x", "id").collect()]
    assert found == list(range(1, 101))
    assert N.numbered(df.limit(0), ["x"], "n").count() == 0
    few = df.select((F.col("id") % 2).cast("string").alias("s"), "id")  # a first column of two values
    found = {(r.s, r.id): r.n for r in N.numbered(few, ["s", "id"], "n").collect()}
    assert found == {(s, i): k for k, (s, i) in enumerate(sorted((str(i % 2), i) for i in range(100)), 1)}
    inside = {(r.s, r.id): r.n for r in N.numbered(few, [F.col("id").desc()], "n", within="s").collect()}
    assert inside == {(str(i % 2), i): 50 - i // 2 for i in range(100)}


MEANINGS = [(1, "the water", 0.90), (2, "sun", 0.95), (3, "spoon", 0.30), (4, "eye", None), (5, None, 0.5)]


def matches(spark):
    words = spark.createDataFrame([(k, k, c) for k, c in enumerate(["WATER", "SPOOM", "EYE", "XYZZY", "SUNS", "WATER", None])], "row_idx long, concept_id long, concept string")
    meanings = spark.createDataFrame(MEANINGS, "id long, name string, score double")
    return M.match_concepts(words, meanings), meanings


def test_matching(spark):
    found, _ = matches(spark)
    assert rows(found, "concept", "id", "match_score", "method") == [("EYE", 4, 1.0, "exact"), ("SPOOM", 3, 0.8, "fuzzy"), ("SUNS", 2, 1.0, "exact"), ("WATER", 1, 1.0, "exact"), ("XYZZY", None, 0.0, "no_match")]
    s = M.match_summary(found).first()
    assert (s.total, s.n_exact, s.n_fuzzy, s.n_unmatched, s.n_scored) == (5, 3, 1, 1, 3)
    assert M.match_summary(found.limit(0)).first().pct_exact is None


@pytest.mark.parametrize(
    "action, query, selection, expected",
    [
        ("N", "", 1, (None, None, 0.8, "manual_no_match")), ("", "", 1, (3, "spoon", 0.8, "fuzzy_accepted")), ("s", "^S", 1, (2, "sun", 1.0, "manual")), ("s", "^s", 3, (3, "spoon", 0.8, "fuzzy")),
        ("s", "4", 1, (4, "eye", 1.0, "manual")), ("what", "", 1, (3, "spoon", 0.8, "fuzzy")), ("q", "", 1, (3, "spoon", 0.8, "fuzzy")),
    ],
)
def test_review(spark, action, query, selection, expected):
    found, meanings = matches(spark)
    decisions = spark.createDataFrame([(0, "n", "", 1), (1, action, query, selection)], "row_idx long, action string, query string, selection int")
    out = {r.concept: r for r in M.apply_review(found, meanings, decisions).collect()}
    r = out["SPOOM"]
    assert (r.id, r.name, r.match_score, r.method) == expected and out["WATER"].method == "exact" and len(out) == 5


def test_partition(spark):
    keys = M.score_keys(spark.createDataFrame([("water", 0.9, 1), ("Water.", 0.2, 2), ("sun", None, 3), ("moon", 0.8, 4), ("x", float("nan"), 5)], "concept string, score double, row_idx long"))
    assert rows(keys, "key", "score", "pos")[:3] == [("MOON", 0.8, 4), ("SUN", None, 3), ("WATER", 0.2, 1)]
    words = spark.createDataFrame([(1, 1, "WATER"), (2, 2, "moonlight"), (3, 3, "sun"), (4, 4, "sunshine"), (5, 5, "hill"), (6, 6, "x")], "row_idx long, concept_id long, concept string")
    found = M.score_partition(words, keys)
    assert rows(found, "concept", "category", "new_id") == [("WATER", "borrowable", 1), ("hill", "unmatched", 3), ("moonlight", "basic", 1), ("sun", "unmatched", 1), ("sunshine", "unmatched", 2), ("x", "unmatched", 4)]


def test_profile(cognates):
    p = C.set_profile(cognates)
    assert rows(p, "cogid", "size", "languages", "concepts", "avg_diversity", "max_diversity", "is_unstable", "flags") == [
        (1, 3, 3, 1, 0.286, 0.429, False, ""), (2, 1, 1, 1, 0.0, 0.0, False, ""), (3, 1, 1, 1, 0.0, 0.0, False, ""),
    ]
    strict = C.set_profile(cognates, size_threshold=2, diversity_threshold=0.2)
    assert rows(strict.where("cogid = 1"), "flags") == [("large(3); diverse(0.29)",)]
    assert rows(C.unstable_ids(strict), "place", "cogid") == [(1, 1)]
    s = C.set_summary(strict, 2, 0.2).first()
    assert (s.n_sets, s.singletons, s.n_unstable, s.max_size) == (3, 2, 1, 3)


def nearest_pair_linkage(d, weight, threshold):
    """Labels by joining the nearest two of all clusters again and again, in exact fractions; ties by first members."""
    groups = [[k] for k in range(len(weight))]
    mean = lambda a, b: sum(d[i][j] * weight[i] * weight[j] for i in a for j in b) / (sum(weight[i] for i in a) * sum(weight[j] for j in b))
    while len(groups) > 1:
        far, i, j = min((mean(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if far > threshold:
            break
        groups[i] += groups.pop(j)
    return [next(k for k, g in enumerate(groups) if m in g) for m in range(len(weight))]


def test_linkage_is_that_of_nearest_pairs():
    rng = np.random.default_rng(0)
    for _ in range(200):  # few distances and small weights, so that ties are everywhere
        n = int(rng.integers(1, 10))
        steps = rng.integers(0, 5, (n, n))
        d = [[Fraction(int(steps[min(i, j), max(i, j)]), 4) for j in range(n)] for i in range(n)]
        weight = [int(x) for x in rng.integers(1, 4, n)]
        tree = merge_tree(condensed(np.array(d, float).reshape(n, n)), np.array(weight))
        for threshold in (0, Fraction(1, 4), Fraction(3, 8), Fraction(1, 2), 1):
            assert tree.labels(float(threshold)).tolist() == nearest_pair_linkage(d, weight, threshold)


def test_linkage_of_members_and_of_weights():
    rng = np.random.default_rng(1)
    for _ in range(50):
        weight = rng.integers(1, 4, 6)
        d = np.triu(rng.integers(1, 6, (6, 6)) / 4, 1)
        d += d.T
        at = np.repeat(np.arange(6), weight)
        few = merge_tree(condensed(d), weight)
        many = merge_tree(condensed(np.where(at[:, None] == at, 0, d[at][:, at])), np.ones(len(at)))
        for threshold in (0.0, 0.5, 0.75, 1.25):
            assert (many.labels(threshold) == few.labels(threshold)[at]).all()


def test_linkage_of_many_members_takes_seconds():
    d = np.random.default_rng(2).random((2000, 2000))
    start = time.perf_counter()
    tree = merge_tree(condensed(d + d.T), np.ones(2000))
    assert time.perf_counter() - start < 10 and tree.labels(2.0).max() == 0 and tree.labels(0.0).max() == 1999


def test_pairs_of_a_large_set_are_dealt_evenly(spark):
    words = spark.range(20_000).select(F.lit(1).cast("long").alias("cogid"), F.concat(F.lit("w"), "id").alias("form"))
    words = words.unionByName(spark.createDataFrame([(2, "a"), (2, "b"), (2, None), (3, "a")], "cogid long, form string"))
    blocks = C.pair_blocks(kept(C.form_counts(words), 'forms'))
    same, a, b = F.col("i") == F.col("j"), F.size("a").cast("long"), F.size("b").cast("long")
    n = F.when(same, a * (a - 1) / 2).otherwise(a * b)
    tasks = blocks.select(F.spark_partition_id().alias("task"), n.alias("n"), (a * b).alias("met")).groupBy("task").agg(F.sum("n").alias("n"), F.max("met").alias("met")).collect()
    assert sum(t.n for t in tasks) == 20_000 * 19_999 // 2 + 3
    assert max(t.n for t in tasks) <= 1.2 * C.TASK_PAIRS and max(t.met for t in tasks) <= (2 * C.TILE) ** 2


def test_pairs_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(C, "TILE", 3)
    monkeypatch.setattr(C, "TASK_PAIRS", 7)
    forms = [(c, "".join(f)) for c in (1, 2) for f in itertools.product("ab", repeat=4)][:-5] + [(3, "x"), (3, None), (3, "x"), (None, "x"), (None, "y")]
    found = rows(C.pair_distances(spark.createDataFrame(forms, "cogid long, form string")), "cogid", "form_a", "form_b", "n_pairs", "distance")
    expected, count = [], Counter((c, f or "") for c, f in forms if c)
    for (c, f), (d, g) in itertools.combinations(sorted(count), 2):
        if c == d:
            distance = sum(x != y for x, y in zip(f, g)) if len(f) == len(g) else max(len(f), len(g))
            expected.append((c, f, g, count[c, f] * count[d, g], distance / max(len(f), len(g))))
    close = [r for r in found if r[0] == 3] == [e for e in expected if e[0] == 3]
    assert close and [r[:4] for r in found] == sorted((e[:4] for e in expected), key=repr)
    assert all(r[4] <= e[4] for r, e in zip(found, sorted(expected, key=repr)))


def test_tone_split(spark):
    data = [(1, 1, "H.H"), (2, 1, "H.H"), (3, 1, "L.L"), (4, 1, "L.L"), (5, 1, None), (6, 2, "H"), (7, 2, "H"), (8, 2, "H"), (9, 7, "H"), (10, 7, "L"), (11, 7, " ")]
    members = spark.createDataFrame(data, "id long, cogid long, pattern string")
    whole = C.tone_split(members)
    assert [r.new_cogid for r in whole.orderBy("id").collect()] == [1, 1, 8, 8, 1, 2, 2, 2, 7, 7, 7]
    decisions = C.split_decisions(C.tone_clusters(members), members.select("cogid").distinct())
    assert rows(decisions, "cogid", "decision") == [(1, "split"), (2, "keep"), (7, "no_tone_data")]
    assert {(r.decision, r.n) for r in C.decision_counts(decisions).collect()} == {("keep", 1), ("split", 1), ("review", 0), ("no_tone_data", 1)}
    unstable = spark.createDataFrame([(1,)], "cogid long")
    assert C.tone_split(members, unstable, compat=True).where("new_cogid = 2").count() == 5  # the collision of Q-9
    assert C.tone_split(members, unstable.limit(0)).where("decision is not null").count() == 11
    assert C.tone_split(members, unstable.where("cogid > 99").union(spark.createDataFrame([(99,)], "cogid long"))).where("new_cogid <> cogid").count() == 0
    assert rows(C.split_details(whole), "cogid", "new_cogids") == [(1, "1,8"), (2, "2"), (7, "7")]
    tones = spark.createDataFrame([(1, "A", "x", "H"), (2, "A", "x", "L"), (3, "A", "x", ""), (4, "B", "x", None)], "row_idx long, concept string, lang string, pattern string")
    assert rows(C.tone_lookup(tones), "concept", "pattern") == [("A", "L")]


def test_matrix_and_nexus(spark, cognates):
    words = cognates.select(F.col("doculect").alias("language"), "concept", "cogid")
    langs = ["L1", "L2", "L3", "L4"]
    cells = {(r.language, r.label): r.state for r in P.presence(words, langs).collect()}
    m = {r.label: (r.L1, r.L2, r.L3, r.L4) for r in P.matrix(words, langs).collect()}
    assert m == {"A_1": ("1", "1", "1", "0"), "A_2": ("0", "0", "0", "1"), "B_3": ("1", "?", "?", "?")} == {k: tuple(cells[c, k] for c in langs) for k in m}
    lines = [r.line for r in P.nexus(words, langs).orderBy("place").collect()]
    assert "    DIMENSIONS NTAX=4 NCHAR=3;" in lines and "L1              101" in lines and "L4              01?" in lines and "    CHARSET all = 1-3;" in lines
    assert [r.line for r in P.nexus_rows(words, langs, 2).where("language = 'L1'").orderBy("block").collect()] == ["L1              10", "L1              1"]
    back = P.read_nexus(P.nexus(words, langs, 2))
    assert rows(back.where("taxon = 'L4'"), "block", "states", "n_taxa", "n_chars") == [(0, "01", 4, 3), (1, "?", 4, 3)]


def test_more_languages_than_bits(spark):
    langs = [f"l{k:03}" for k in range(150)]
    words = [(c, f"c{k % 7}", k % (3 + j)) for k, c in enumerate(langs) for j in range(3) if k % 11] + [("other", "c0", 99), ("l001", "c3", None), (None, "c1", 5)]
    found = {(r.language, r.concept, r.cogid): r.state for r in P.presence(spark.createDataFrame(words, "language string, concept string, cogid long"), langs).collect()}
    classes = {(c, k) for _, c, k in words if k is not None}
    assert found == {(lang, c, k): "1" if (lang, c, k) in words else "0" if any(w[:2] == (lang, c) for w in words) else "?" for lang in langs for c, k in classes}


def test_pages_by_ranges_of_bytes(spark, tmp_path):
    pages = [f"page {k} " + "é漢 " * (k % 900) if k % 13 else " " for k in range(5000)]
    (tmp_path / "book.txt").write_text("\f".join(pages), encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        ranges = S.read_ordered(spark, str(tmp_path), "\f")
        assert ranges.rdd.getNumPartitions() > 50
        assert rows(S.read_pages(spark, str(tmp_path)), "page_no", "text") == sorted(((k, p) for k, p in enumerate(pages, 1) if p != " "), key=repr)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_books_of_one_file(spark, tmp_path):
    """Many books go to one file, and come back page by page."""
    texts = {k: "\f".join(f"page {k}\t{j}\n é" if (j + k) % 3 else " " for j in range(k % 5 + 1)) for k in range(400)}
    S.write_books(spark.createDataFrame([*texts.items(), (None, "x")], "doc long, text string").repartition(2), str(tmp_path / "books"))
    assert len(list((tmp_path / "books").rglob("*.txt"))) <= 2
    expected = [(str(k), j, p) for k, t in texts.items() for j, p in enumerate(t.split("\f"), 1) if p != " "] + [("", 1, "x")]
    assert rows(S.read_books(spark, str(tmp_path / "books")), "doc", "page_no", "text") == sorted(expected, key=repr)


def test_coverage_counts_once(spark):
    """Rows are counted once for both parts of the figures, and a blank is told without a replacement."""
    forms = spark.createDataFrame([(1, 0, "AA", "x"), (1, 0, "BB", "\u00a0y "), (1, 1, "AA", "\u2003"), (2, 0, "AA", None)], "concept_id long, pos long, lang string, form string")
    stats = W.coverage_stats(forms)
    assert stats.inputFiles() and all("/wide_rows-" in f for f in stats.inputFiles())
    assert (stats.first().n_rows, stats.first().max_langs) == (1, 2)


def test_tree(spark):
    trees = spark.createDataFrame([("f", "((L1:1,L2:1)[&posterior=0.97]:1,L3:2)[&posterior=1.0];"), ("g", None)], "file string, newick string")
    nodes = P.parse_trees(trees)
    assert rows(nodes.where("posterior is not null"), "posterior") == [(0.97,), (1.0,)]
    placed = P.layout(nodes).join(nodes.select("node_id", "label"), "node_id")
    assert {(r.label, r.x, r.y) for r in placed.where("is_tip").collect()} == {("L1", 2.0, 0.0), ("L2", 2.0, 1.0), ("L3", 2.0, 2.0)}
    assert rows(placed.where("not is_tip"), "x", "y") == [(0.0, 1.25), (1.0, 0.5)]
    d = P.drawing(placed).first()
    assert (d.tips, d.depth, d.scale, d.height) == (3, 2.0, 0.2, 8.0) and P.segments(placed).count() == 8
    shown = nodes.where("posterior is not null").select(*(c.alias(f"c{k}") for k, c in enumerate(P.support_labels(F.col("posterior")))))
    assert rows(shown, "c0", "c1") == [("0.970", 7), ("1.000", 7)]
    names = spark.createDataFrame([("L1", "One", 1), ("L9", "One", 2), ("L2", "Two", 3)], "code string, name string, ord int")
    colours = spark.createDataFrame([("L1", "red")], "code string, colour string")
    tips = nodes.where("label <> ''").select("label")
    assert rows(P.tip_labels(tips, names, colours), "label", "name", "colour") == [("L1", "One", "red"), ("L2", "Two", "black"), ("L3", "L3", "black")]


def test_cognate_detection(spark):
    words = [(c, lang, f, list(f)) for c in ("a", "b", "c") for lang, f in (("x", f"pat{c}"), ("y", f"bat{c}"), ("z", f"mimo{c}l"), ("w", f"pat{c}"))]
    df = spark.createDataFrame(words, "concept string, lang string, form string, tokens array<string>")
    sets = L.cognate_sets(df, (0.0, 0.3, 0.6, 1.0), draws=50)
    n = [r.n_sets for r in L.sweep_summary(sets).orderBy("threshold").collect()]
    assert n == sorted(n, reverse=True) and n[-1] == 3
    ids = L.with_set_ids(sets)
    own = {(r.threshold, r.concept, r.lang): r.cogid for r in ids.collect()}
    assert all(own[t, c, "x"] == own[t, c, "w"] for t in (0.0, 0.3) for c in "abc")
    assert ids.groupBy("threshold", "cogid").agg(F.count_distinct("concept").alias("k")).where("k > 1").count() == 0
    again = L.cognate_sets(df.repartition(1), (0.0, 0.3, 0.6, 1.0), draws=50)
    assert rows(again, "threshold", "concept", "lang", "local") == rows(sets, "threshold", "concept", "lang", "local")


def test_scores_in_parts():
    import numpy as np

    rng = np.random.default_rng(5)
    words = [rng.integers(0, 6, n) for n in (0, 1, 3, 5, 9, 12)]
    a, b = rng.integers(0, 6, 3 * L.AT_ONCE + 7), rng.integers(0, 6, 3 * L.AT_ONCE + 7)
    scores = rng.choice([-1.0, -0.5, 0.25, 1.0], (6, 6))
    assert np.array_equal(L.scores_many(words, a, b, scores), L.align_many(words, a, b, scores)[0]) and not len(L.scores_many(words, a[:0], b[:0], scores))


def test_sets_by_places(spark):
    """Few words are many tasks' work; a concept's distances go to its sets as numbers, without the words."""
    words = [(f"c{c}", f"l{k % 5}", f"{'pbtdkg'[k % 6]}a{'mnszlr'[k // 6]}{c}") for c in range(4) for k in range(36)]
    df = spark.createDataFrame([(*w, list(w[2])) for w in words], "concept string, lang string, form string, tokens array<string>")
    own, distances = L._distances(df, 200)
    place = {(r.concept, r.lang, r.form): r.place for r in own.collect()}
    for c in range(4):
        assert [k for k, _ in sorted((w[1:], place[w]) for w in words if w[0] == f"c{c}")] == [k[1:] for k in sorted(place, key=place.get) if k[0] == f"c{c}"]
    found = distances.collect()
    assert len(found) == sum(a[0] == b[0] and a[1] < b[1] for a in words for b in words)
    assert all((r.place_a, r.place_b) == (place[r.concept, r.lang_a, r.form_a], place[r.concept, r.lang_b, r.form_b]) for r in found)
    whole = own.where("concept = 'c1'").select("concept", "lang", "form", "place").toArrow()
    numbers = distances.where("concept = 'c1'").select("concept", "place_a", "place_b", "distance").toArrow()
    sets = {(r["lang"], r["form"]): r["local"] for r in L._sets(whole, numbers, (0.4,)).to_pylist()}
    assert sets == {(r.lang, r.form): r.local for r in L.cognate_sets(df, (0.4,), 200).where("concept = 'c1'").collect()}


def test_sets_of_members(spark):
    """A form that many languages have comes to a concept's group once; the sets are those of all words with all their distances."""
    forms = ["pata", "bada", "pat", "bat", "mimo", "nimo"]
    words = [(c, f"l{k:02}", f, list(f)) for c in "ab" for k in range(12) for f in forms if (k * 7 + len(f) + ord(f[0])) % 3]
    words += [("b", lang, f, list("sol")) for lang, f in (("l00", "s-ol"), ("l00", "so-l"), ("l01", "s-ol"), ("l02", "so-l"))]  # the segments are the same, the forms are not
    df = spark.createDataFrame(words, "concept string, lang string, form string, tokens array<string>")
    own, distances = L._distances(df, 200)
    members = {(r.concept, r.lang, r.form): r.member for r in own.collect()}
    assert len({members[w[:3]] for w in words if w[0] == "a"}) == 6 and len({members[w[:3]] for w in words if w[0] == "b"}) == 10
    found = {(r.threshold, r.concept, r.lang, r.form): r.local for r in L.cognate_sets(df, (0.0, 0.3, 0.5, 0.8), 200).collect()}
    assert len(found) == 4 * len(words)
    for c in "ab":
        whole = own.where(F.col("concept") == c).select("concept", "lang", "form", "place").toArrow()
        numbers = distances.where(F.col("concept") == c).select("concept", "place_a", "place_b", "distance").toArrow()
        for r in L._sets(whole, numbers, (0.0, 0.3, 0.5, 0.8)).to_pylist():
            assert found[r["threshold"], c, r["lang"], r["form"]] == r["local"]


@pytest.mark.parametrize("most", [1, 9])
def test_sets_of_a_concept_larger_than_a_group(spark, monkeypatch, most):
    """Rounds over the cluster, with ties, give the sets of one tree in memory; no group has more than MEMBERS clusters."""
    rng = random.Random(6)
    words = {("a", f"l{rng.randrange(5)}", "".join(rng.choice(("ptk", "aei")[i % 2]) for i in range(rng.choice((3, 4))))) for _ in range(60)}
    words |= {("b", lang, f) for lang in ("l1", "l2") for f in ("pat", "bad")} | {("a", "l1", "p-at"), ("a", "l2", "pa-t"), ("a", "l2", "p-at")}
    df = spark.createDataFrame([(*w, list(w[2].replace("-", ""))) for w in sorted(words)], "concept string, lang string, form string, tokens array<string>")
    ask = lambda: {(r.threshold, r.concept, r.lang, r.form): r.local for r in L.cognate_sets(df, (0.0, 0.3, 0.5, 0.6, 1.0), 200).collect()}
    whole = ask()
    monkeypatch.setattr(L, "MEMBERS", most)
    assert len(whole) == 5 * len(words) and ask() == whole


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('ConceptID,Concept,AA\n1,"say ""x"", or\ny",NA\n2,nan,b\n', encoding="utf-8")
    csv = S.read_csv(spark, str(tmp_path / "a.csv"))
    assert rows(csv, "ConceptID", "Concept", "AA") == [("1", 'say "x", or\ny', None), ("2", None, "b")]
    assert rows(S.read_csv(spark, str(tmp_path / "a.csv"), na_tokens=()), "AA") == [("NA",), ("b",)]
    (tmp_path / "w.tsv").write_text("# note\nID\tCONCEPT\tDOCULECT\tTOKENS\tCOGID\n1\tA\tx\tp a\t3\n2\tA\ty\tp\t3\n", encoding="utf-8")
    words = S.read_wordlist(spark, str(tmp_path / "w.tsv"))
    assert rows(words, "id", "tokens", "cogid") == [(1, ["p", "a"], 3), (2, ["p"], 3)]
    assert tuple(S.wordlist_size(words).first()) == (2, 1, 2)
    (tmp_path / "ids.txt").write_text("3\n\n 5 \n")
    assert rows(S.read_ids(spark, str(tmp_path / "ids.txt")), "id") == [(3,), (5,)]
    (tmp_path / "p.txt").write_text("one\ntwo\f\fthree")
    assert rows(S.read_pages(spark, str(tmp_path / "p.txt")), "page_no", "text") == [(1, "one\ntwo"), (3, "three")]
    (tmp_path / "t.tree").write_text("x\ntree T = [&R] (a,\nb);\ntree U = (c);")
    (tmp_path / "u.tree").write_text("tree U = (c,d);")
    assert rows(S.read_trees(spark, str(tmp_path / "*.tree")), "newick") == [("(a,\nb)",), ("(c,d)",)]
    S.write_split(words.select("id", "doculect"), str(tmp_path / "out"), "doculect")
    assert (tmp_path / "out" / "doculect=x").is_dir()
    S.write_csv(words.drop("tokens"), str(tmp_path / "csv"), order=["id"])
    assert S.read_csv(spark, str(tmp_path / "csv")).count() == 2
    S.write_lines(words, str(tmp_path / "lines"), "id", ["id"])
    assert rows(S.read_ids(spark, str(tmp_path / "lines")), "id") == [(1,), (2,)]
    with pytest.raises(ValueError):
        S.require(words, "id", "none")


def test_expected_counts_are_exact(spark):
    import math
    from collections import Counter

    words = [("A", "l", "pata"), ("A", "m", "bada"), ("A", "m", "sol"), ("B", "l", "kusu"), ("B", "m", "guzu"), ("C", "l", "mano"), ("C", "m", "pata"), ("D", "l", "pata"), ("D", "m", "nima")]
    df = spark.createDataFrame([(*w, list(w[2])) for w in words], "concept string, lang string, form string, tokens array<string>")
    pairs = [(c, L.typed(list(f)), L.typed(list(g)), f, g) for c, a, f in words for d, b, g in words if c == d and a < b]
    attested, expected = Counter(), Counter()
    for _, f, g, *_ in pairs:
        d, aligned = L._distance(f, g, L._by_class)
        attested.update(aligned if d < L.CUT else ())
        for _, _, h, *_ in pairs:
            d, aligned = L._distance(f, h, L._by_class)
            expected.update(aligned if d < L.CUT else ())

    def score(x, y):
        odds = math.log2((attested[x, y] + 0.5) / (expected[x, y] / len(pairs) + 0.5))
        return L._by_class(x, y) if x.split("/")[0] == y.split("/")[0] else L.MIX * max(-1.0, min(1.0, odds / 2)) + (1 - L.MIX) * L._by_class(x, y)

    own = {(c, f, g): L._distance(t, u, score)[0] for c, t, u, f, g in pairs}
    found = {(r.concept, r.form_a, r.form_b): r.distance for r in L.word_distances(df, None).collect()}
    assert found == pytest.approx(own)
    drawn = {(r.concept, r.form_a, r.form_b): r.distance for r in L.word_distances(df, 1000).collect()}
    assert drawn.keys() == own.keys() and all(abs(drawn[k] - own[k]) < 0.1 for k in own)
    again = {(r.concept, r.form_a, r.form_b): r.distance for r in L.word_distances(df.repartition(1), 1000).collect()}
    assert again == drawn
    assert L.typed(["p", "a", "t"]) == ["p/^", "a/V", "t/$"]


def test_drawn_counts_are_near_the_exact_ones(spark):
    rng = random.Random(4)
    words = {(f"c{k // 3 % 12}", "lmn"[k % 3], "".join(rng.choice(("ptkbdg", "aeiou")[i % 2]) for i in range(rng.randint(2, 6)))) for k in range(900)}
    df = spark.createDataFrame(sorted(words), "concept string, lang string, word string")
    side = lambda s: df.select("concept", F.col("lang").alias(f"lang_{s}"), F.col("word").alias(f"form_{s}"), F.array_join(F.split("word", ""), L.JOINED).alias(f"word_{s}"))
    pairs = side("a").join(side("b"), "concept").where("lang_a < lang_b")
    counts = lambda of, draws: {(r.lang_a, r.lang_b, r.x, r.y): (r.attested, r.expected) for r in L.segment_counts(of, draws).collect()}
    exact, drawn = counts(pairs, None), counts(pairs, L.DRAWS)
    n = {(r.lang_a, r.lang_b): r.n for r in pairs.groupBy("lang_a", "lang_b").agg(F.count("*").alias("n")).collect()}
    met = {(r.lang_a, r.lang_b): r.n for r in L.drawn_pairs(pairs)[0].groupBy("lang_a", "lang_b").agg(F.sum("drawn").alias("n")).collect()}
    assert len(n) == 3 and all(v * v > 20 * L.DRAWS and abs(met[k] - L.DRAWS) < 0.1 * L.DRAWS for k, v in n.items())
    for key, (attested, expected) in exact.items():
        a, e = drawn.get(key, (0, 0.0))
        assert a == attested and abs(e - expected) <= 6 * (expected * n[key[:2]] / L.DRAWS) ** 0.5 + 4 * n[key[:2]] / L.DRAWS
    assert counts(pairs.repartition(1), L.DRAWS) == drawn == counts(pairs.repartition(8), L.DRAWS)


def test_alignments_at_once_are_those_one_by_one():
    rng = np.random.default_rng(3)
    scores = rng.normal(size=(6, 6))
    words = [rng.integers(0, 6, rng.integers(0, 7)) for _ in range(40)]
    a, b = rng.integers(0, 40, 200), rng.integers(0, 40, 200)
    found, pair, x, y = L.align_many(words, a, b, scores)
    for k in range(200):
        s, aligned = L.align(list(words[a[k]]), list(words[b[k]]), lambda i, j: scores[i, j])
        assert abs(found[k] - s) < 1e-12 and sorted(zip(x[pair == k], y[pair == k])) == sorted(aligned)


def test_fuzzy_matches_equal_brute_force(spark):
    from wordloom.functions.unicode import sequence_ratio

    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdeé "), rng.integers(1, 9)))
    names = [(k, word()) for k in range(40)] + [(50, "tide"), (51, "diet"), (52, "edit"), (53, None), (54, "tide"), (55, "")]
    asked = sorted({word() for _ in range(40)} | {"diet", "tides", "DIETS", "x"})
    concepts = spark.createDataFrame([(c, k, k) for k, c in enumerate(asked)], "concept string, concept_id long, row_idx long")
    meanings = spark.createDataFrame([(k, n, 0.5) for k, n in names], "id long, name string, score double")
    variants = {r.concept: [] for r in concepts.collect()}
    for r in M.with_variants(concepts).orderBy("concept", "ord").collect():
        variants[r.concept].append(r.variant)
    for threshold in (0.6, 0.8):
        expected = []
        for c, own in variants.items():
            best = max(((sequence_ratio(v, n), -k, -i) for k, v in enumerate(own) for i, n in names if n), default=(0, 0, 0))
            if best[0] >= threshold:
                expected.append((c, -best[2], round(best[0], 9)))
        found = [(r.concept, r.id, round(r.match_score, 9)) for r in M.fuzzy_match(concepts, meanings, threshold).collect()]
        assert sorted(found) == sorted(expected)


def test_containment_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("ABC"), rng.integers(1, 7)))
    for extra in ([], [(900, "", 0.1)]):
        keys = [(k, w, None if k % 5 == 0 else k / 100) for k, w in enumerate(sorted({word() for _ in range(30)}), 1)] + extra
        asked = sorted({word() for _ in range(40)} | {"", "ZZZ", "Z", "ABCABCABC"})
        expected = []
        for a in asked:
            hit = next(((p, s) for p, k, s in keys if k in a or a in k), None)
            if hit:
                expected.append((a, *hit))
        found = M.containing(spark.createDataFrame([(a,) for a in asked], "key string"), spark.createDataFrame(keys, "pos long, of string, score double"))
        assert rows(found, "key", "pos", "score") == sorted(expected, key=repr)


def test_candidates_stay_few_as_meanings_grow(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(9, 14)))
    names = [word() for _ in range(3000)]
    asked = [n[:4] + n[5:] for n in names[:100]]
    few, many = (
        M.fuzzy_candidates(spark.createDataFrame([(a,) for a in asked], "text string"), spark.createDataFrame([(n,) for n in names[:k]], "text string"), 0.8) for k in (300, 3000)
    )
    assert {(r.variant, r.name) for r in few.collect()} >= set(zip(asked, names[:100]))
    assert few.count() <= 2 * len(asked) and many.count() <= 3 * len(asked)


def test_automata():
    rng = random.Random(2)
    for letters, texts in (("ab", 30), ("abc", 60), ("a", 12)):
        word = lambda n: "".join(rng.choice(letters) for _ in range(rng.randint(1, n)))  # noqa: E731, B023
        patterns, read = sorted({word(6) for _ in range(40)}), [word(15) for _ in range(texts)] + [""]
        value = [rng.randint(0, 99) for _ in patterns]
        one = Automaton(patterns)
        assert one.least_in(read, value) == [min((v for p, v in zip(patterns, value) if p in t), default=None) for t in read]
        assert one.first_with(read) == [next((k for k, t in enumerate(read) if p in t), None) for p in patterns]
    assert Automaton([]).least_in(["x"], []) == [None] and Automaton(["x"]).first_with([]) == [None]


def test_containment_where_all_parts_are_shared(spark, monkeypatch):
    """Every string has the same trigrams, and each is in half of the others; blocks and slices are several."""
    monkeypatch.setattr(patterns, "BLOCK", 100)
    monkeypatch.setattr(patterns, "SLICE", 130)
    keys = spark.range(1, 600).select(F.repeat(F.lit("ab"), F.col("id").cast("int")).alias("key"))
    others = spark.range(1, 600).select(F.col("id").alias("pos"), F.concat(F.repeat(F.lit("ab"), (600 - F.col("id")).cast("int")), F.lit("a")).alias("of"), (F.col("id") / 1000).alias("score"))
    start = time.perf_counter()
    found = {len(r.key) // 2: r.pos for r in M.containing(keys, others).collect()}
    assert found == dict.fromkeys(range(1, 600), 1) and time.perf_counter() - start < 60


def test_newick_without_a_stack():
    rng = random.Random(1)
    for _ in range(100):
        want, made = [(0, None, 0)], [""]

        def grow(node, left):
            kids = rng.randint(1, 3) if left else 0
            parts = []
            for k in range(kids):
                want.append((len(want), node, k))
                parts.append(grow(len(want) - 1, left - rng.randint(1, 2) if left > 1 else 0))
            return (f"({','.join(parts)})" if parts else "") + f"n{node}:{node / 4}"

        made = grow(0, rng.randint(0, 6))
        assert [(i, p, k, f"n{i}", i / 4, None) for i, p, k in want] == newick.nodes(made + ";junk(")
    assert newick.nodes("('it''s; (x)':1, b [&rate=1,posterior=0.5]:2e0)[&posterior=1.0];") == [(0, None, 0, "", 0.0, 1.0), (1, 0, 0, "it's; (x)", 1.0, None), (2, 0, 1, "b", 2.0, 0.5)]
    for bad in ("(a,b));", "((a,b);", "a,b;", "(a)(b);", "(a,'b);", "(a[b);"):
        with pytest.raises(ValueError):
            newick.nodes(bad)
    start = time.perf_counter()
    star = newick.nodes("(" + ",".join(f"t{k}:1" for k in range(1_000_000)) + ");")
    assert len(star) == 1_000_001 and star[-1] == (1_000_000, 0, 999_999, "t999999", 1.0, None) and time.perf_counter() - start < 60


def test_trees_of_files():
    assert newick.first_tree("#NEXUS\nBEGIN TREES;\n Translate 1 'a;b';\n tree A = [&U] (a,b);\n TREE * 'x' = [&r] ('c;d',e);\nEND;") == "('c;d',e)"
    assert newick.first_tree("utree t = (a,b);") == "(a,b)" and newick.first_tree("street t = (a,b);") is None
    assert newick.first_tree("BEGIN TREES; END;") is None and newick.first_tree("tree a = ") is None and newick.first_tree("tree a = 'x;") is None


def test_a_comb_takes_few_rounds(spark):
    levels = 2_000
    comb = spark.range(2 * levels + 1).select(F.col("id").alias("node_id"), F.when(F.col("id") > 0, 2 * F.floor((F.col("id") - 1) / 2)).cast("long").alias("parent_id"), ((F.col("id") + 1) % 2).alias("child_ord"), F.lit(0.5).alias("length"))
    start = time.perf_counter()
    found = {r.node_id: r for r in P.layout(comb).collect()}
    took = time.perf_counter() - start
    y = {2 * levels: float(levels)}
    for k in range(levels - 1, -1, -1):  # node 2k has the tip 2k + 1, the k-th, and then node 2k + 2
        y[2 * k], y[2 * k + 1] = (k + y[2 * k + 2]) / 2, float(k)
    assert all(abs(found[k].y - v) < 1e-6 and found[k].depth == -(-k // 2) and found[k].x == 0.5 * -(-k // 2) for k, v in y.items())
    assert len(found) == 2 * levels + 1 and took < 90
    with pytest.raises(ValueError, match="ancestors"):
        P.doubled(spark.createDataFrame([(1, 2, 0), (2, 1, 0)], "node_id long, parent_id long, n long"), ("n",), ())


def test_kept_tables_are_cleared(spark):
    from wordloom.sources import shared

    table = kept(spark.range(3), "some")
    path = table.inputFiles()[0].rsplit("/", 1)[0]
    assert table.count() == 3 and S.exists(spark, path)
    assert shared.cleared(spark) >= 1 and not S.exists(spark, path) and shared.cleared(spark) == 0


def test_figures_of_the_job_that_writes(spark, tmp_path):
    rows = [(f"c{k}", None if k % 4 == 0 else 0.5, ("exact", "fuzzy", "no_match")[k % 3]) for k in range(30)]
    df = spark.createDataFrame(rows, "concept string, score double, method string")
    found = summaries.written(df, lambda x: x.write.parquet(str(tmp_path / "m")), summaries.match_metrics())
    assert found == {"total": 30, "n_exact": 10, "n_fuzzy": 10, "n_scored": 22} and spark.read.parquet(str(tmp_path / "m")).count() == 30
