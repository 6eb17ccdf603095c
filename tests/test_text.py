"""Hand-traced values of the scalar functions."""

import difflib
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from wordloom.functions import text as T
from wordloom.functions import unicode as U

NFD = lambda x: unicodedata.normalize("NFD", x) if isinstance(x, str) else x
joined = lambda f: lambda c: F.array_join(f(c), "|")
tones, simple = (lambda f: lambda c: T.pattern(f(c)))(T.tones), (lambda f: lambda c: T.pattern(f(c)))(T.tones_simple)

CASES = [
    (tones, "bárì", "H.L"), (tones, "kaó̀", "H.L"), (tones, "kóɔ́̀", "H.L"), (tones, "toí̀o", "H.L.U"), (tones, "ãká", "U.H"), (tones, "", ""), (tones, None, ""),
    (simple, "kaó̀", "U.H"), (simple, "okɔ́̀", "U.H"), (T.strip_tone, "a b c d", "ab cd"), (T.strip_tone, "kãó", "kão"), (T.strip_tone, None, ""),
    (U.nasal_repair, "ba ̃", "bã"), (U.nasal_repair, "bañ", "bãn"), (U.nasal_repair, "aa ̃", "ãã"), (U.nasal_repair, "əñ", "ən"), (U.nasal_repair, "-̃a", "-a"),
    (U.nasal_repair, "bo ̃ ta", "bõta"), (U.nasal_repair, "ka t̃a", "kã ta"), (U.nasal_repair, "", ""), (U.nasal_repair, None, None),
    (joined(T.tokens), "gbã", "gb|ã"), (joined(T.tokens), "kp̃a", "kp̃|a"), (joined(T.tokens), "tʃa", "t|ʃ|a"), (joined(T.tokens), "gb́a", "gb|́|a"), (joined(T.tokens), "ba-ta ka", "b|a|t|a|k|a"),
    (T.orthography, "yac", "jatʃ"), (T.orthography, "aya", "aya"), (T.orthography, "ja", "dʒa"), (T.clean_concept, "12. to eat, chew", "TO EAT"), (T.clean_concept, "3= 'sun' (hot) cf. moon", "SUN"),
    (T.normalise_a, "The Eye (of man)", "eye"), (T.normalise_a, "to eat!", "eat"), (T.normalise_b, "sun/day: x.", "SUN DAY X"),
    (joined(T.clean_forms), "béni, bení / beni [check] S ?", "béni|bení|beni"), (joined(T.clean_forms), "- , a. / *", ""), (joined(T.clean_forms), None, ""), (joined(T.clean_forms), "wa also wo, =gloss x / 'q'", "wa|q"),
    (joined(T.variants), "Suns", "suns|the suns|to suns|sun|the sun"), (joined(T.variants), "x / y", "x / y|the x / y|to x / y|x / ys|the x / ys|x|the x|y|the y"),
    (T.taxon, "A b-c", "A_b_c"), (T.glue_marks, "a ́b", "áb"), (T.strip, "  x ", "x"), (T.strip_marks, "a\u0303\u0301b", "ab"), (T.strip_marks, "\u2193é\u2191k\u031a´", "ék´"), (T.strip_marks, None, ""), (T.number, "1.5", 1.5), (T.number, "NaN", None), (T.number, "x", None),
]


def test_golden_values(spark):
    for f in dict.fromkeys(c[0] for c in CASES):
        own = [c for c in CASES if c[0] is f]
        rows = spark.createDataFrame([(k, c[1]) for k, c in enumerate(own)], "k int, x string").select("k", f(F.col("x")).alias("y")).collect()
        for r in rows:
            assert NFD(r.y) == NFD(own[r.k][2]), own[r.k]


@pytest.mark.parametrize(
    "segments, tone, mapping, expected",
    [
        ("p a n i", "H.L", "syllable", "p_H a_H n_H i_L"), ("a k a i", "H.L", "syllable", "a_H k_H a_L i_L"), ("p a n", "H.L", "segment", "p_H a_L n_X"), ("p a", "L.H", "word", "p_L a_L"),
        ("p a", None, "word", "p_X a_X"), ("p a", None, "syllable", "p_X a_X"), ("p a", None, "segment", "p_X a_X"),
    ],
)
def test_tone_segments(spark, segments, tone, mapping, expected):
    row = spark.createDataFrame([(segments.split(), tone.split(".") if tone else [])], "s array<string>, t array<string>")
    assert row.select(F.array_join(T.tone_segments(F.col("s"), F.col("t"), mapping), " ").alias("x")).first().x == expected


def test_distances(spark):
    rows = spark.createDataFrame([("kitten", "sitting", 3 / 7), ("", "a", 1.0), ("", "", 0.0), ("ɛ́", "e", 1.0)], "a string, b string, x double")
    assert all(abs(r.d - r.x) < 1e-12 for r in rows.withColumn("d", T.edit_distance(F.col("a"), F.col("b"))).collect())
    rows = spark.createDataFrame([("H.L", "H.L.U", 2 / 3), ("H", "H", 1.0), ("H", "L", 0.0)], "a string, b string, x double")
    assert all(abs(r.d - r.x) < 1e-12 for r in rows.withColumn("d", T.tone_similarity(F.split("a", "[.]"), F.split("b", "[.]"))).collect())
    assert (U.sequence_ratio("tide", "diet"), U.sequence_ratio("diet", "tide")) == (0.25, 0.5)


@settings(max_examples=200, deadline=None)
@given(st.text("aeouəbkntm -̃́", max_size=12))
def test_nasal_repair_is_stable(form):
    once = U.repair_nasal(form)
    assert "  " not in once and once == once.strip()
    assert unicodedata.normalize("NFD", once) == once or not form
    assert sum(c in "bkntm" for c in once) == sum(c in "bkntm" for c in form)


@settings(max_examples=100, deadline=None)
@given(st.text("abcde", max_size=8), st.text("abcde", max_size=8))
def test_ratio_bound_used_by_matching(a, b):
    r = difflib.SequenceMatcher(None, a, b).ratio()
    assert 0 <= r <= 1 and (not a + b or r <= 2 * min(len(a), len(b)) / len(a + b) + 1e-12)
