"""Column builders for text, ids, clocks and seasons. A null text counts as '' in tests of text."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def says(text: Column, pattern: str) -> Column:
    """Whether the pattern occurs, in any letter case; never null.

    Plain words are looked for without a regular expression; several tests of one text in one
    projection share its lower-case form.
    """
    plain = F.coalesce(text, F.lit(""))
    if re.fullmatch(r"[A-Za-z0-9 ]+", pattern):
        return F.contains(F.lower(plain), F.lit(pattern.lower()))
    if re.search(r"\\[A-Z]", pattern):
        return plain.rlike(f"(?iu){pattern}")
    return F.lower(plain).rlike(pattern.lower())


def game_id(c: Column) -> Column:
    """Ten digits, zero-padded, without a decimal zero; longer ids stay whole."""
    t = F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")
    return F.when(F.length(t) < 10, F.lpad(t, 10, "0")).otherwise(t)


#: letters that have no decomposition
UNMARKED = {"ł": "l", "ø": "o", "đ": "d", "ı": "i", "ð": "d", "ħ": "h", "ŧ": "t", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"}


@lru_cache(maxsize=1)
def _decomposed() -> tuple[str, str]:
    """Letters with marks below U+2000, and the letters that their canonical decompositions begin with."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x2000) if unicodedata.normalize("NFD", chr(c)) != chr(c)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold_name(c: Column) -> Column:
    """Lower case, marks taken off as by canonical decomposition, anything but letters a-z and digits as one blank."""
    t = F.regexp_replace(F.translate(F.lower(c), *_decomposed()), r"\p{M}+", "")
    for letter, plain in UNMARKED.items():
        t = F.replace(t, F.lit(letter), F.lit(plain))
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def clock_seconds(c: Column) -> Column:
    """Seconds of ``MM:SS``, ``MM:SS.t`` or ``PT11M31.00S``; null for anything else."""
    colon, iso = r"^(\d+):(\d{1,2}(?:\.\d+)?)$", r"^PT(\d+)M(\d+(?:\.\d+)?)S$"
    pattern = F.when(c.rlike(colon), F.lit(colon)).when(c.rlike(iso), F.lit(iso))

    def part(k: int) -> Column:
        return F.when(c.rlike(colon), F.regexp_extract(c, colon, k)).when(c.rlike(iso), F.regexp_extract(c, iso, k)).cast("double")

    return F.when(pattern.isNotNull(), part(1) * 60 + part(2))


def season_label(end_year: Column) -> Column:
    """``2025-26`` of the season that ends in 2026."""
    return F.concat((end_year - 1).cast("string"), F.lit("-"), F.lpad((end_year % 100).cast("string"), 2, "0"))


def season_of(date: Column, first_month: int = 10) -> Column:
    """End year of the season a date belongs to."""
    return F.year(date) + F.when(F.month(date) >= first_month, 1).otherwise(0)


def four_digit_year(two: Column) -> Column:
    """Two digits to four with the century turning after 50."""
    return F.when(two <= 50, two + 2000).otherwise(two + 1900)


def seconds_left(period: Column, clock: Column) -> Column:
    """Seconds to the end of regulation, or of the overtime period being played."""
    return F.when(period <= 4, (4 - period) * 720 + clock).otherwise(clock)
