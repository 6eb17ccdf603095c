"""Vectorised functions for which Spark has no expression: Unicode normal forms, sequence ratio, nasal repair."""

from __future__ import annotations

import difflib
import functools
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TILDE = "̃"
#: Vowels of nasal repair (S-19): a fixed set, without schwa.
NASAL_VOWELS = "aeiouɛɔɪʊAEIOUƐƆƗ"


def _vectorised(one, c: Column) -> Column:
    """A string function on a column, batch by batch; null stays null. Made on use: workers import this module, too."""

    def batch(text: pd.Series) -> pd.Series:
        return text.map(one, na_action="ignore")

    return F.pandas_udf(batch, StringType())(c)


def nfc(c: Column) -> Column:
    """Normal form C."""
    return _vectorised(functools.partial(unicodedata.normalize, "NFC"), c)


def nfd(c: Column) -> Column:
    """Normal form D."""
    return _vectorised(functools.partial(unicodedata.normalize, "NFD"), c)


def sequence_ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio of lower-cased strings, 2 * matches / total length; the order of arguments counts."""
    return sequence_ratio_to(b)(a)


def sequence_ratio_to(b: str) -> Callable[[str], float]:
    """sequence_ratio with b as the second string, whose letters are indexed once."""
    matcher = difflib.SequenceMatcher(None, "", b.lower())

    def ratio(a: str) -> float:
        matcher.set_seq1(a.lower())
        return matcher.ratio()

    return ratio


_DOUBLE = re.compile(rf"([aeiouɛɔɪʊ])\1\s*{TILDE}\s*{TILDE}?")
_UNITS = re.compile(rf"(?P<tilde>(?:(?<=[ \-])|^){TILDE})|(?P<space>\s)|(?P<hyphen>-)|(?P<unit>[^\s\-](?:(?!\s)[̀-ͯ])*)")


def repair_nasal(form: str) -> str:
    """Puts stray tildes back on vowels (S-18 to S-20); the result is in normal form D."""
    if not form:
        return form
    text = unicodedata.normalize("NFD", form)
    text = _DOUBLE.sub(lambda m: (m[1] + TILDE) * 2, text)
    items = [(m.lastgroup, m[0]) for m in _UNITS.finditer(text)]
    out: list[str] = []

    def give_back() -> None:
        """The nearest vowel before gets a tilde unless it has one; blanks and hyphens are looked across."""
        for k in range(len(out) - 1, -1, -1):
            if out[k] and out[k][0] in NASAL_VOWELS:
                if TILDE not in out[k]:
                    out[k] += TILDE
                return

    i = 0
    while i < len(items):
        kind, item = items[i]
        j = i + 1
        while j < len(items) and items[j][0] in ("tilde", "space"):
            j += 1
        ahead = sum(k == "tilde" for k, _ in items[i + 1 : j])
        step = i + 1
        if kind == "unit":
            if item[0] in NASAL_VOWELS:
                out.append(item + TILDE * ahead)
                step = j if ahead else step
            else:
                if TILDE in item or ahead:
                    give_back()
                    step = j if ahead else step
                out.append(item.replace(TILDE, ""))
        elif kind == "space" and step < len(items) and items[step][0] != "tilde" or kind == "hyphen":
            out.append(item)
        i = step
    return re.sub(r"\s+", " ", "".join(out)).strip()


def nasal_repair(c: Column) -> Column:
    return _vectorised(repair_nasal, c)
