"""Text functions over columns. All are JVM expressions; only ``nfc`` for other scripts than Bengali needs Python."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .profiles import BENGALI, BN_DIGITS, Profile

SPACES = r"(?U)\s+"
#: The characters of that class, for functions that need no regex.
SPACE_CHARS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
MARKS = "।,!?-–—\"'()[]"
_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ASCII_DIGITS = "0123456789"


def arrow(function):
    """A function from text to text over columns, in Arrow batches; null stays null."""

    def column(c: Column, **options) -> Column:
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda t: None if t is None else function(t, **options))

        return F.pandas_udf(run, "string")(c)

    column.__doc__ = function.__doc__
    return column


def nfc(c: Column) -> Column:
    """Unicode NFC for any script."""
    return arrow(lambda t: unicodedata.normalize("NFC", t))(c)


def nfc_bengali(c: Column) -> Column:
    """NFC of the Bengali block alone: the nukta letters come apart, the two-part vowel signs join, a nukta goes before a hasanta."""
    for a, b in (("ড়", "ড়"), ("ঢ়", "ঢ়"), ("য়", "য়"), ("়্", "়্"), ("ো", "ো"), ("ৌ", "ৌ")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


#: The no-break space, then the zero-width characters that go.
_CLEANED = "\xa0\u200c\u200b\ufeff"


def clean_unicode(c: Column, joiners: bool = False, form=nfc_bengali) -> Column:
    """NFC, no zero-width characters, plain spaces; ``joiners``: U+200D goes too, and a doubled danda becomes one."""
    c = F.translate(form(c), _CLEANED + ("\u200d" if joiners else ""), " ")
    return F.replace(c, F.lit("।।"), F.lit("।")) if joiners else c


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def spaced(c: Column, blanks: str = "", also: dict[str, str] | None = None) -> Column:
    """Every white space and each of ``blanks`` as a plain space; ``also``: other characters and what they become, "" for nothing."""
    also = also or {}
    spaces = SPACE_CHARS + blanks
    kept, gone = [k for k, v in also.items() if v], [k for k, v in also.items() if not v]
    return F.translate(c, spaces + "".join(kept + gone), " " * len(spaces) + "".join(also[k] for k in kept))


def single_spaces(c: Column) -> Column:
    """No spaces at the ends and single ones inside, where ``spaced`` has left no other."""
    return F.regexp_replace(F.trim(c), "  +", " ")


def normalize_sentence(c: Column, profile: Profile = BENGALI, form=nfc_bengali) -> Column:
    """A sentence as curation compares it: no line number, single spaces, plain dashes, no doubled marks."""
    c = spaced(form(c), also={"–": "-", "—": "-"} | {x: "" for x in _CLEANED[1:]})
    c = single_spaces(F.regexp_replace(c, r"(?U)^\d+[,.]? *", ""))
    for run, mark in (("।।+", "।"), (r"\.\.+", profile.stop), (r"\?\?+", "?"), ("!!+", "!")):
        c = F.regexp_replace(c, run, mark)
    return F.regexp_replace(c, r"([।.!?])[।.!?]+\n?\z", "$1")


def collapse_marks(c: Column) -> Column:
    """Plain dashes; a run of sentence marks becomes its first."""
    return F.regexp_replace(F.translate(c, "–—", "--"), "([।,.!?])[।,.!?]+", "$1")


def remove_latin(c: Column) -> Column:
    return single_spaces(spaced(c, also={x: "" for x in _LETTERS}))


def dedup_key(c: Column) -> Column:
    """Twelve hex digits that are equal for texts that differ in case or white space only."""
    return F.substring(F.md5(F.regexp_replace(F.lower(c), SPACES, "").cast("binary")), 1, 12)


def words(c: Column) -> Column:
    return F.array_remove(F.split(c, SPACES), "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def sentence_type(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("?")), "question").when(F.contains(c, F.lit("!")), "exclamation").otherwise("statement")


@lru_cache
def _members(chars: str) -> str | None:
    """The characters of the inside of a regex class; None if only Java's regexes know it."""
    try:
        return "".join(re.findall(f"[{chars}]", "".join(chr(i) for i in range(1, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000)))
    except re.error:
        return None


def _count_of(c: Column, chars: str) -> Column:
    """How many characters of a text the regex class holds."""
    listed = _members(chars)
    if listed is None:
        return F.length(F.regexp_replace(c, f"[^{chars}]", ""))
    return F.length(c) - F.length(F.translate(c, listed, ""))


def script_share(c: Column, profile: Profile = BENGALI) -> Column:
    """The share of code points that a valid text of the profile may hold; 0 for an empty text."""
    return F.when(F.length(c) > 0, _count_of(c, profile.letters + profile.others) / F.length(c)).otherwise(0.0)


def is_valid(c: Column, profile: Profile = BENGALI, least: float = 0.7) -> Column:
    return F.coalesce(script_share(c, profile) >= least, F.lit(False))


def clean_or_null(c: Column, shortest: int = 2, longest: int = 500, profile: Profile = BENGALI) -> Column:
    """The stripped text, or null if its length is out of range or under half of it, spaces aside, is of the script."""
    t = strip(c)
    return F.when(F.length(t).between(shortest, longest) & (_count_of(t, profile.letters) >= 0.5 * F.length(F.replace(t, F.lit(" "), F.lit("")))), t)


def compare_form(c: Column, form=nfc_bengali) -> Column:
    """A word or text as alignment compares it: marks to spaces, NFC, single spaces, lower case."""
    return F.lower(single_spaces(form(spaced(c, MARKS))))


def to_ascii_digits(c: Column) -> Column:
    return F.translate(c, BN_DIGITS, _ASCII_DIGITS)


def digits_to_int(c: Column) -> Column:
    """The digits of a text, of either script, as one number; 0 without any."""
    return F.coalesce(F.nullif(F.regexp_replace(to_ascii_digits(c), "[^0-9]", ""), F.lit("")).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once for each row, wherever the optimizer moves the expression."""
    return F.transform(F.array(value), body)[0]


def unit_list(c: Column, profile: Profile = BENGALI) -> Column:
    """The inventory units (category:unit) that a text contains, in inventory order."""
    return let(c, lambda t: F.array_compact(F.array(*[F.when(F.contains(t, F.lit(u.split(":", 1)[1])), F.lit(u)) for u in profile.labelled()])))


def conjunct_list(c: Column, profile: Profile = BENGALI) -> Column:
    return let(c, lambda t: F.array_compact(F.array(*[F.when(F.contains(t, F.lit(u)), F.lit(u)) for u in profile.units.get("conjunct", [])])))


def char_kind(c: Column) -> Column:
    """The class of a single Bengali character."""
    return (
        F.when(c.rlike("^[ক-নপ-রলশ-হৎ]$"), "consonant")
        .when(c.rlike("^[অ-ঌএঐওঔৠ]$"), "vowel")
        .when(c.rlike("^[া-ৃেৈোৌ]$"), "matra")
        .when(c == "্", "hasanta")
        .when(c == "ঁ", "chandrabindu")
        .otherwise("other")
    )


def is_safe_name(c: Column) -> Column:
    """No parent folder and no shell characters."""
    return ~c.rlike(r"\.\.|[;&|`$<>\n\r]") & (c != "")


def is_within(path: Column, base: str) -> Column:
    """Whether a path lies in a folder."""
    base = base.rstrip("/")
    return (path == base) | F.startswith(path, F.lit(base + "/")) & ~path.rlike(r"(^|/)\.\.(/|$)")


def recording_name(speaker: Column, at: Column, prompt: Column) -> Column:
    """speaker_time_prompt.wav, the time as %Y%m%dT%H%M%SZ."""
    return F.concat_ws("_", speaker, F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"), F.concat(prompt, F.lit(".wav")))


def prompt_of(name: Column) -> Column:
    """The prompt id that a recording's name ends with."""
    return F.regexp_extract(name, r"_([^_]*)\.wav$", 1)
