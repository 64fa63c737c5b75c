"""Numbers, dates, money and telephone numbers as Bengali words; Latin words spelled out.

Number words are written by place: hundreds, then thousands, lakhs and crores, where the count of crores is a number
itself. ``words_of`` works on Python integers of any size; ``spoken`` is the fused Arrow function over texts.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import arrow

# --- Fixed values ---------------------------------------------------------------------------------
UNDER_THIRTY = (
    "শূন্য এক দুই তিন চার পাঁচ ছয় সাত আট নয় দশ এগারো বারো তেরো চৌদ্দ পনেরো ষোলো সতেরো আঠারো উনিশ "
    "বিশ একুশ বাইশ তেইশ চব্বিশ পঁচিশ ছাব্বিশ সাতাশ আটাশ ঊনত্রিশ"
).split()
TENS = dict(zip(range(30, 100, 10), "ত্রিশ চল্লিশ পঞ্চাশ ষাট সত্তর আশি নব্বই".split()))
HUNDRED_ENDING, ONE_HUNDRED, MINUS, POINT = "শো", "একশো", "ঋণাত্মক", "দশমিক"
PLACES = ((10_000_000, "কোটি"), (100_000, "লাখ"), (1000, "হাজার"))
MONTHS = "জানুয়ারি ফেব্রুয়ারি মার্চ এপ্রিল মে জুন জুলাই আগস্ট সেপ্টেম্বর অক্টোবর নভেম্বর ডিসেম্বর".split()
TAKA, PAISA, YEAR = "টাকা", "পয়সা", "সাল"
LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", "এ বি সি ডি ই এফ জি এইচ আই জে কে এল এম এন ও পি কিউ আর এস টি ইউ ভি ডব্লিউ এক্স ওয়াই জেড".split()))
#: How money, telephone numbers, dates, numbers and years are written.
_MONEY = re.compile(r"৳\s*([০-৯\d]+)(?:\.([০-৯\d]+))?")
_PHONE = re.compile(r"\b(?:০১[৩-৯][০-৯]{8}|01[3-9]\d{8})\b")
_DATE = re.compile(r"([০-৯\d]{1,2})[/\-]([০-৯\d]{1,2})[/\-]([০-৯\d]{2,4})")
_NUMBER = re.compile(r"([০-৯\d]+)(?:\.([০-৯\d]+))?")
_YEAR = re.compile(r"([০-৯\d]{4})\s*(?:সাল|সালে|সালের)?")
# ---------------------------------------------------------------------------------------------------

_LATIN = re.compile(r"\b[a-zA-Z]+\b")
_MARKS = re.compile(r"[।,;:!?\"'()\[\]{}–—\-]")
_RUN = re.compile(r"[।,.!?]+")
_DROP = dict.fromkeys(map(ord, "‌‍​﻿")) | {0xA0: " "}


def words_of(n: int) -> str:
    """A whole number in words."""
    if n < 0:
        return f"{MINUS} {words_of(-n)}"
    out = []
    for size, name in PLACES:
        if n >= size:
            out.append(f"{words_of(n // size)} {name}")
            n %= size
    if n >= 100:
        out.append(UNDER_THIRTY[n // 100] + HUNDRED_ENDING if n >= 200 else ONE_HUNDRED)
        n %= 100
    if n >= 30:
        out.append(TENS[n - n % 10])
        n %= 10
    if n or not out:
        out.append(UNDER_THIRTY[n])
    return " ".join(out)


def _digit_words(digits: str) -> str:
    return " ".join(UNDER_THIRTY[int(d)] for d in digits)


def money(text: str) -> str:
    """৳ amounts; what follows the point counts paisa."""

    def say(m: re.Match) -> str:
        out = f"{words_of(int(m[1]))} {TAKA}"
        return f"{out} {words_of(int(m[2]))} {PAISA}" if m[2] and int(m[2]) else out

    return _MONEY.sub(say, text)


def phones(text: str) -> str:
    return _PHONE.sub(lambda m: _digit_words(m[0]), text)


def dates(text: str) -> str:
    """Day, month, year; a month out of range leaves the text as it is."""
    return _DATE.sub(lambda m: f"{words_of(int(m[1]))} {MONTHS[int(m[2]) - 1]} {words_of(int(m[3]))}" if 1 <= int(m[2]) <= 12 else m[0], text)


def years(text: str) -> str:
    return _YEAR.sub(lambda m: f"{words_of(int(m[1]))} {YEAR}", text)


def numbers(text: str) -> str:
    """Whole numbers in words, digits behind a point one by one."""
    return _NUMBER.sub(lambda m: words_of(int(m[1])) + (f" {POINT} {_digit_words(m[2])}" if m[2] else ""), text)


def spell_latin(text: str) -> str:
    """Latin words letter by letter, run together."""
    return _LATIN.sub(lambda m: "".join(LETTERS[c] for c in m[0].lower()), text)


def spoken_text(text: str, expand: bool = True, spell: bool = True) -> str:
    """A text as it is read aloud: NFC, single marks, then money, phones, dates, numbers and Latin words in words, no punctuation."""
    text = unicodedata.normalize("NFC", text).translate(_DROP).replace("।।", "।")
    text = _RUN.sub(lambda m: m[0][0], text.replace("–", "-").replace("—", "-"))
    text = dates(phones(money(text)))
    text = numbers(text) if expand else text
    text = spell_latin(text) if spell else text
    return " ".join(_MARKS.sub(" ", text).split())


spoken, expand_money, expand_phones, expand_dates, expand_years, expand_numbers, spell_latin_words = map(arrow, (spoken_text, money, phones, dates, years, numbers, spell_latin))


def number_words(c: Column) -> Column:
    """``words_of`` as a JVM expression, for whole numbers below a thousand crore."""
    small = F.array(*[F.lit(words_of(i)) for i in range(100)])
    under = lambda n: F.element_at(small, (n + 1).cast("int"))
    n = F.abs(c.cast("bigint"))
    crore = F.floor(n / 10_000_000)

    def below_crore(x: Column) -> Column:
        hundreds = F.floor(x % 1000 / 100)
        lakh, thousand, rest = F.floor(x / 100_000), F.floor(x % 100_000 / 1000), x % 100
        return F.filter(
            F.array(
                F.when(lakh > 0, F.concat(under(lakh), F.lit(" লাখ"))),
                F.when(thousand > 0, F.concat(under(thousand), F.lit(" হাজার"))),
                F.when(hundreds == 1, F.lit(ONE_HUNDRED)).when(hundreds > 1, F.concat(under(hundreds), F.lit(HUNDRED_ENDING))),
                F.when(rest > 0, under(rest)),
            ),
            lambda w: w.isNotNull(),
        )

    parts = F.concat(
        F.when(c < 0, F.array(F.lit(MINUS))).otherwise(F.array().cast("array<string>")),
        F.when(crore > 0, F.concat(below_crore(crore), F.array(F.lit("কোটি")))).otherwise(F.array().cast("array<string>")),
        below_crore(n % 10_000_000),
    )
    return F.when(c == 0, UNDER_THIRTY[0]).when(n < 10_000_000_000, F.array_join(parts, " "))
