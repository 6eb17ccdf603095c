"""Scalar functions on words, concepts and tone patterns as Column expressions.

word character and a blank are; the classes here name both, so that results are the same.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .unicode import nfc, nfd

# Fixed values.
BLANK = r"[\s\x{A0}\x{1C}-\x{1F}\x{85}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LETTER = r"[\p{L}\p{N}_]"
GLUED_MARKS = r"\x{301}\x{300}\x{304}\x{302}\x{30C}\x{303}\x{330}\x{339}\x{31A}"
WORD_MARKS = r"\x{330}\x{301}\x{300}\x{304}\x{302}\x{30C}\x{303}"
FORM_LETTERS = "a-zɔɛəʊɪũãẽĩõ"
TONE_VOWELS = "aeiouəɛɔʊɪAEIOUƏƐƆ"
PITCH_MARKS, PITCH_TONES = "́̀̄̂̌", "HLMRF"
STAND_ALONE = "´`¯ˆˇ↓↑"
MAPPING_VOWELS = "aeiouɛɔɪʊəæɑɨʉɯ"
DIGRAPHS = ("gb", "kp", "mb", "nd", "ŋg", "ŋm", "ny", "dʒ")
ANNOTATIONS = (r"\[check\]", r"\?\?+", r"\bcheck\b", r"\bid\.", r"\bsp\.", r"cf\.", r"\bJ\s+\d+", r"\bS\b", r"\bGb\b", r"\bGB\b")
JUNK = ("", "-", "*", "+", "?", "??", "a.", "b.")
# Acute, grave, macron, circumflex, caron, tilde, tilde below, arrows down and up, right half ring below, left angle above.
STRIPPED_MARKS = "\u0301\u0300\u0304\u0302\u030c\u0303\u0330\u2193\u2191\u0339\u031a"


def _sub(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def _bounded(pattern: str) -> str:
    r"""\b before a pattern's first letter or after its last, as Python has it: combining marks are no word characters. The first letter is looked at first."""
    if pattern.startswith(r"\b"):
        pattern = f"(?={pattern[2]})(?<!{LETTER}){pattern[2:]}"
    if pattern.endswith(r"\b"):
        pattern = f"{pattern[:-2]}(?!{LETTER})"
    return pattern.replace(r"\s", BLANK)


def strip(c: Column) -> Column:
    """Without blanks at both ends, no-break spaces included."""
    return _sub(c, f"^{BLANK}+|{BLANK}+$", "")


def squeeze(c: Column) -> Column:
    return _sub(c, f"{BLANK}+", " ")


def non_blank(c: Column) -> Column:
    """FI-1: not null and not only blanks."""
    return F.coalesce(c.rlike(f"[^{BLANK[1:]}"), F.lit(False))


def glue_marks(c: Column) -> Column:
    """S-2: composed, and marks moved back to the letter before a space."""
    c = _sub(nfc(c), rf"[ \x{{A0}}]([{GLUED_MARKS}])", "$1")
    return _sub(c, rf"({LETTER}){BLANK}+([\x{{300}}-\x{{36F}}])", "$1$2")


def fix_word(c: Column) -> Column:
    """S-3."""
    c = _sub(glue_marks(c), rf"(?iu)([{FORM_LETTERS}]){BLANK}+([{WORD_MARKS}])", "$1$2")
    return strip(squeeze(c))


def clean_concept(c: Column) -> Column:
    """S-4: the headword of a concept line, in upper case."""
    c = glue_marks(c)
    c = _sub(strip(c), rf"^\d+(?:[=.]|{BLANK})+", "")
    c = _sub(c, r"\([^)]*\)", "")
    c = _sub(c, r"(?i)cf\..*$", "")
    c = _sub(c, r"=.*$", "")
    c = F.substring_index(F.substring_index(c, ",", 1), "/", 1)
    c = _sub(c, rf"^(?:['\"]|{BLANK})+|(?:['\"]|{BLANK})+$", "")
    return F.upper(squeeze(c))


def orthography(c: Column) -> Column:
    """S-5: spelling to phonetic signs; y at a word's start, or between two characters that aren't vowels, becomes j."""
    c = F.replace(F.replace(fix_word(c), F.lit("c"), F.lit("tʃ")), F.lit("j"), F.lit("dʒ"))
    c = _sub(c, rf"(?=y)(?<!{LETTER})y", "j")
    vowel = r"aeiouɛɔəʊɪãẽĩõṹ\x{301}\x{300}\x{304}\x{302}\x{30C}"
    return _sub(c, f"([^{vowel}])y([^{vowel}])", "$1j$2")


def _is_word(w: Column) -> Column:
    return ~w.isin(*JUNK) & ~w.rlike(rf"^(?:[\-*+?.]|{BLANK})+$")


def clean_forms(c: Column) -> Column:
    """S-6: the forms in a translation, an array; null gives an empty one."""
    c = glue_marks(c)
    for pattern in ANNOTATIONS:
        c = _sub(c, "(?iu)" + _bounded(pattern), "")
    c = _sub(c, r"=[^,/]+", "")
    c = _sub(c, r"\([^)]*\)", "")
    for word in ("also", "contrast"):
        c = _sub(c, rf"(?iu)(?={word[0]})(?<!{LETTER}){word}{BLANK}+(?:(?!{BLANK})[^,/])+", "")
    c = F.translate(c, "'\"", "")
    c = _sub(c, rf"[*+](?={BLANK}|$)", "")
    c = _sub(c, r"\?+", "")
    words = F.filter(F.transform(F.split(c, "[,/]"), strip), _is_word)
    # Python functions don't go inside lambdas: the words are fixed joined by a sign that no step touches, then split again
    fixed = F.split(orthography(F.array_join(words, " \x01 ")), "\x01")
    fixed = F.filter(F.transform(fixed, strip), _is_word)
    return F.coalesce(fixed, F.array().cast("array<string>"))


def strip_marks(c: Column) -> Column:
    """S-7: without marks that stand by themselves, composed; letters that are one character with their mark keep it. Null gives ''."""
    return F.coalesce(nfc(F.translate(c, STRIPPED_MARKS, "")), F.lit(""))


def normalise_a(c: Column) -> Column:
    """S-8: a concept as matching compares it."""
    c = _sub(strip(F.lower(c)), r"\([^)]*\)", "")
    c = _sub(strip(c), rf"^(?:the|a|an){BLANK}+", "")
    c = _sub(c, rf"^to{BLANK}+", "")
    c = _sub(c, r"[.,;:!?'\"()\-]", " ")
    return strip(squeeze(c))


def normalise_b(c: Column) -> Column:
    """S-9: a concept as the partition compares it."""
    c = F.translate(F.translate(strip(F.upper(c)), "/,", "  "), ".:", "")
    return strip(squeeze(c))


def variants(c: Column) -> Column:
    """S-10: the spellings under which a concept may be listed, an array without repeats, in the order of the rules."""
    raw, norm = strip(F.lower(c)), normalise_a(c)
    the = lambda x: F.concat(F.lit("the "), x)
    none = F.array().cast("array<string>")
    single = F.substring(norm, F.lit(1), F.length(norm) - 1)
    plural = F.concat(norm, F.lit("s"))
    ends = F.endswith(norm, F.lit("s"))
    number = F.when(ends & (F.length(norm) > 3), F.array(single, the(single))).when(~ends, F.array(plural, the(plural))).otherwise(none)
    either = F.when(F.contains(norm, F.lit(" or ")), F.flatten(F.transform(F.split(norm, " or "), lambda x: F.array(strip(x), the(strip(x)))))).otherwise(none)
    parts = F.when(
        F.contains(c, F.lit("/")), F.flatten(F.transform(F.split(c, "/"), lambda x: F.array(normalise_a(x), the(normalise_a(x)))))
    ).otherwise(none)
    first = F.array(raw, norm, the(norm), F.concat(F.lit("to "), norm))
    return F.array_distinct(F.concat(first, number, either, parts))


def _vowel_marks(word: Column) -> Column:
    """For each vowel of a word the tones of its pitch marks, as letters."""
    marks = F.regexp_extract_all(nfd(word), F.lit(rf"[{TONE_VOWELS}](\p{{Mn}}*)"), F.lit(1))
    kept = F.transform(marks, lambda m: F.translate(_sub(m, f"[^{PITCH_MARKS}]", ""), PITCH_MARKS, PITCH_TONES))
    return F.coalesce(kept, F.array().cast("array<string>"))


def tones(word: Column) -> Column:
    """S-11: tones of a word's vowels. Of two marks on a vowel the first belongs to the vowel before, if that has none."""
    t = _vowel_marks(word)
    before, after = F.concat(F.array(F.lit("-")), t), F.slice(t, F.lit(2), F.greatest(F.size(t), F.lit(1)))
    near = F.filter(F.arrays_zip(t.alias("m"), before.alias("before"), after.alias("after")), lambda x: x["m"].isNotNull())

    def one(x: Column) -> Column:
        m, after = x["m"], F.coalesce(x["after"], F.lit(""))
        return (
            F.when((m == "") & (F.length(after) >= 2), F.substring(after, 1, 1))
            .when(m == "", F.lit("U"))
            .when((F.length(m) >= 2) & (x["before"] == ""), F.substring(m, 2, 1))
            .otherwise(F.substring(m, -1, 1))
        )

    return F.transform(near, one)


def tones_simple(word: Column) -> Column:
    """S-12: the first pitch mark of each vowel, U without."""
    return F.transform(_vowel_marks(word), lambda m: F.when(m == "", F.lit("U")).otherwise(F.substring(m, 1, 1)))


def pattern(t: Column) -> Column:
    return F.array_join(t, ".")


def strip_tone(c: Column) -> Column:
    """S-13: without pitch marks; other marks stay. Letters parted by blanks are joined. Null becomes empty."""
    plain = _sub(F.translate(nfd(c), STAND_ALONE, ""), f"[{PITCH_MARKS}]", "")
    letters = "a-zəɛɔʊɪũãẽĩõ"
    plain = _sub(plain, rf"(?iu)([{letters}]){BLANK}+([{letters}])", "$1$2")
    return F.coalesce(strip(nfc(plain)), F.lit(""))


def tone_similarity(a: Column, b: Column) -> Column:
    """S-14 of two arrays: equal places over the longer length; equal arrays have 1."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when(a == b, 1.0).otherwise(same / F.greatest(F.size(a), F.size(b), F.lit(1)))


def tone_segments(segments: Column, t: Column, mapping: str = "syllable") -> Column:
    """S-15: segments with their tones. word: the first tone on all; segment: one by one, X where they end; syllable: by vowel. X without tones."""
    n = F.size(t)
    if mapping == "word":
        return F.transform(segments, lambda s: F.concat_ws("_", s, F.coalesce(F.get(t, F.lit(0)), F.lit("X"))))
    if mapping == "segment":
        return F.transform(segments, lambda s, i: F.concat_ws("_", s, F.coalesce(F.get(t, i), F.lit("X"))))
    if mapping != "syllable":
        raise ValueError(f"mapping is word, segment or syllable, not {mapping}")
    is_vowel = lambda s: F.lower(s).rlike(f"[{MAPPING_VOWELS}]")
    seen = lambda i: F.size(F.filter(F.slice(segments, 1, i + 1), is_vowel))
    return F.transform(segments, lambda s, i: F.concat_ws("_", s, F.coalesce(F.get(t, F.greatest(F.lit(1), F.least(n, seen(i))) - 1), F.lit("X"))))


def edit_distance(a: Column, b: Column) -> Column:
    """S-16: Levenshtein distance of code points over the longer length; 0 if equal, 1 if one is empty."""
    return F.when(a == b, 0.0).otherwise(F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def tokens(form: Column) -> Column:
    """S-21: segments of a form; digraphs stay together, with a tilde that follows."""
    pairs = "|".join(DIGRAPHS)
    return F.regexp_extract_all(nfd(form), F.lit(rf"(?s)(?:{pairs})\x{{303}}?|[^ \-][\p{{Mn}}\p{{Mc}}]*"), F.lit(0))


def number(c: Column) -> Column:
    """S-23: a double, null where the text isn't one or is NaN."""
    x = c.try_cast("double") if hasattr(c, "try_cast") else F.expr(f"try_cast({c} as double)")
    return F.when(~F.isnan(x), x)


def posteriors(newick: Column) -> Column:
    """S-25: the posterior values in a tree text, in order."""
    return F.transform(F.regexp_extract_all(newick, F.lit(r"posterior=([0-9.Ee-]+)"), F.lit(1)), lambda x: x.cast("double"))


def taxon(c: Column) -> Column:
    """S-26."""
    return F.translate(c, " -", "__")
