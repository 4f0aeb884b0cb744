"""Text rules as Column expressions: cleaning and contact-detail checks.

Everything here is a native expression, so it stays inside the JVM and in the same
stage as the scan that feeds it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteloom import constants as K

# All characters that count as white space, spelled out so that the engine's default
# (ASCII only) does not decide it.
WHITESPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


WHITESPACE_CHARS = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


def clean_text(s: Column) -> Column:
    """Collapse white space to single spaces, trim, and turn empty into null."""
    return F.nullif(F.trim(F.regexp_replace(s, WHITESPACE, " ")), F.lit(""))


def strip_text(s: Column) -> Column:
    """Trim all kinds of white space at both ends, leave the inside alone."""
    return F.btrim(s, F.lit(WHITESPACE_CHARS))


def words(s: Column) -> Column:
    return F.filter(F.split(s, WHITESPACE), lambda w: w != "")


# One pattern instead of one comparison per entry: the lists are long, the rules are used
# inside array functions, and a plan with thousands of nodes takes longer to plan than to
# run. Common beginnings are shared, so that a wrong character rules out many entries.
def _any_of(entries: list[str]) -> str:
    by_first: dict[str, list[str]] = {}
    for e in entries:
        by_first.setdefault(e[:1], []).append(e[1:])
    branches = [
        "" if first == "" else re.escape(first) + (_any_of(rest) if len(rest) > 1 else re.escape(rest[0]))
        for first, rest in sorted(by_first.items(), reverse=True)
    ]
    return "(?:" + "|".join(branches) + ")"


def contains_any(s: Column, needles: list[str]) -> Column:
    return s.rlike(_any_of(needles))


def starts_with_any(s: Column, needles: list[str]) -> Column:
    return s.rlike(r"\A" + _any_of(needles))


def ends_with_any(s: Column, needles: list[str]) -> Column:
    return s.rlike(_any_of(needles) + r"\z")


def equals_any(s: Column, values: list[str]) -> Column:
    return s.rlike(r"\A" + _any_of(values) + r"\z")


def capitalize(s: Column) -> Column:
    """First character upper, all others lower."""
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 30)))


def text_sample(s: Column, chars: int | None = None) -> Column:
    """The text, or its first ``chars`` characters where the caller asks for them."""
    return s if chars is None else F.substring(s, 1, chars)


# --- e-mail and phone -------------------------------------------------------------


def valid_email(addr: Column) -> Column:
    low = F.lower(addr)
    local = F.substring_index(low, "@", 1)
    domain = F.substring(low, F.length(local) + 2, F.length(low))
    return (
        ~low.rlike(K.IMAGE_SUFFIX_PATTERN)
        & ~equals_any(domain, K.PLACEHOLDER_DOMAINS)
        & ~equals_any(local, K.PLACEHOLDER_LOCALS)
    )


def range_list_like(s: Column) -> Column:
    """Two or more tokens of the form N-M with M > N: a size table, not a number."""

    def ascending(t: Column) -> Column:
        lo = F.substring_index(t, "-", 1).try_cast("int")
        hi = F.substring_index(t, "-", -1).try_cast("int")
        return t.rlike(K.RANGE_TOKEN_PATTERN) & (hi > lo)

    return F.size(F.filter(words(s), ascending)) >= 2


def digit_count(s: Column) -> Column:
    return F.length(F.regexp_replace(s, r"(?U)\D", ""))


def valid_phone(s: Column) -> Column:
    return digit_count(s).between(*K.PHONE_DIGITS) & ~range_list_like(s)


def emails_in(raw: Column) -> Column:
    # The pattern is slow on text without any @, which is most text.
    found = F.when(
        raw.contains("@"), F.regexp_extract_all(raw, F.lit(K.EMAIL_PATTERN), F.lit(0))
    ).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.filter(found, valid_email)))


def phones_in(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit("(?U)" + K.PHONE_PATTERN), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, strip_text), valid_phone)))


def percent_decode(s: Column) -> Column:
    """Decode %XX only; a plus sign stays a plus sign. Broken escapes stay as they are."""
    lone_percent = F.regexp_replace(s, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(F.replace(lone_percent, F.lit("+"), F.lit("%2B"))), s)


def tel_number(href: Column) -> Column:
    """Number behind a tel: link, null when the link is of another kind or invalid."""
    raw = strip_text(percent_decode(F.substring(href, 5, 1 << 30)))
    is_tel = F.lower(F.substring(href, 1, 4)) == "tel:"
    return F.when(is_tel & (raw != "") & valid_phone(raw), raw)
