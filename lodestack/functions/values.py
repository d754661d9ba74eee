"""Column functions for published text values: markers, numbers, dates, ids and names.

All are compositions of built-in functions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The texts by which the sources say that there is no value.
MARKERS = ("", "N/A", "Not Available", "Not Applicable", "Too Few to Report", ".")

#: White space that a published cell may carry around its value.
BLANKS = " \t\r\n "

#: Latin letters with marks and the letters they fold to; ``ß`` and ``Ł`` stay.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLDED = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"

#: Area words at the end of a county name, longest first; CITY is part of the name.
COUNTY_WORDS = ("CITY AND BOROUGH", "CENSUS AREA", "MUNICIPALITY", "COUNTY", "PARISH", "BOROUGH")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stripped(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(BLANKS))


def is_marker(c: Column | str) -> Column:
    """True for null and for every marker of a missing value, blanks and case aside."""
    return _col(c).isNull() | F.lower(stripped(c)).isin(*(m.lower() for m in MARKERS))


def clean_text(c: Column | str) -> Column:
    """The text without blanks around it; null for null and markers."""
    return F.when(~is_marker(c), stripped(c))


def squash(c: Column | str) -> Column:
    """A text apart from case and blanks: lower case, one blank between words; null for null and markers."""
    return F.when(~is_marker(c), F.lower(F.regexp_replace(stripped(c), r"[\s\u00a0]{2,}|[\t\r\n\x0b\f\u00a0]", " ")))


def to_number(c: Column | str, kind: str = "double") -> Column:
    """Strict number: markers become null, thousands commas and percent signs go, anything else that is
    no number is an error (ANSI cast). Integers written with a decimal part are rounded half away from zero."""
    text = F.regexp_replace(stripped(c), "[,%]", "")
    value = text.cast("double")
    return F.when(~is_marker(c), F.round(value).cast(kind) if kind in ("int", "bigint") else value.cast(kind))


def try_number(c: Column | str, kind: str = "double") -> Column:
    """As ``to_number``, but null where the text is no number."""
    return F.when(~is_marker(c), F.regexp_replace(stripped(c), r"[,%\s]", "").try_cast(kind))


def number_key(c: Column | str) -> Column:
    """One text for each number however it is written (``1,360``, ``1360.0``, `` 1360 %``); other texts
    in lower case; null for null and markers. For comparing values, not spellings."""
    text = F.regexp_replace(_col(c), r"[,%\s\u00a0]", "")
    return F.when(~is_marker(c), F.coalesce(text.try_cast("decimal(38,10)").cast("string"), F.lower(text)))


def to_date_us(c: Column | str) -> Column:
    """MM/DD/YYYY, month and day with or without leading zero; strict."""
    return F.to_date(stripped(c), "M/d/yyyy")


def facility_number(c: Column | str) -> Column:
    """The six-character hospital number: no blanks, upper case, lost leading zeros restored; null if blank."""
    own = _col(c).cast("string")
    text = F.upper(F.regexp_replace(own, r"[\s\u00a0]", ""))
    padded = F.lpad(text, F.greatest(F.length(text), F.lit(6)), F.lit("0"))
    # Most are as they should be; the rest of the expression is for the others.
    return F.when(own.rlike("^[0-9A-Z]{6}$"), own).when(own.rlike(r"[^\s\u00a0]"), padded)


def fold_accents(c: Column | str) -> Column:
    return F.translate(_col(c), ACCENTED, FOLDED)


def clean_county_name(c: Column | str) -> Column:
    """The key by which county names of different sources meet: accents folded, upper case, no dots or
    apostrophes, SAINT as ST, area word dropped (never CITY), no blanks."""
    name = F.upper(fold_accents(F.trim(_col(c))))
    name = F.regexp_replace(name, "[.'’]", "")
    name = F.regexp_replace(name, r"\bSAINT ", "ST ")
    name = F.regexp_replace(name, rf" (?:{'|'.join(COUNTY_WORDS)})$", "")
    return F.regexp_replace(name, " ", "")
