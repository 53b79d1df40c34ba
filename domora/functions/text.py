"""Column functions over addresses and free text."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from domora.functions import config as C


def nfc(text: Column) -> Column:
    """Unicode NFC by the ICU library that Spark brings along; Spark has no function of its own for it."""
    return F.when(text.isNotNull(), F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False)))


def composed(text: Column) -> Column:
    """Unicode NFC; only texts with combining marks are looked at."""
    return F.when(text.rlike(r"\p{M}"), nfc(text)).otherwise(text)


#: White space that is not a single space already; texts without it are left as they are.
UNEVEN_SPACE = r"(?U)[\s&&[^ ]]\s*| \s+"


def normalised(text: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed; null reads as empty. Cleaning has composed the text."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), UNEVEN_SPACE, " "))


def area_of(location: Column) -> Column:
    """District of an address."""
    return area_in(normalised(location))


def area_in(text: Column) -> Column:
    """District of a normalised address: merged districts first, then numbered, then named ones, else Unknown."""
    keywords, merged = C.MERGED_AREA
    first = F.when(_has(text, keywords), merged)
    # null without a number; the pattern is met once, and only where its word stands
    number = F.get(F.regexp_extract_all(text, F.lit(r"(?U)quận\s+(1[0-2]|[1-8])(?:\D|$)"), F.lit(1)), F.lit(0))
    numbered = F.when(text.contains("quận"), F.concat(F.lit("Quận "), number))
    named = reduce(lambda out, k: out.when(text.contains(k), C.NAMED_AREAS[k]), C.NAMED_AREAS, F)
    return F.coalesce(first, numbered, named.otherwise(C.UNKNOWN_AREA))


def chunks_of(text: Column) -> Column:
    """The comma-separated parts of a normalised address."""
    return F.transform(F.split(text, ","), lambda x: F.trim(x))


def first_with(parts: Column, *words: str) -> Column:
    """First part that has one of the words; empty without one."""
    return F.coalesce(F.try_element_at(F.filter(parts, lambda x: F.greatest(*[x.contains(w) for w in words])), F.lit(1)), F.lit(""))


def ward_in(parts: Column) -> Column:
    return first_with(parts, "phường", "xã")


def street_in(parts: Column) -> Column:
    return first_with(parts, "đường", "hẻm")


def ward_of(location: Column) -> Column:
    return ward_in(chunks_of(normalised(location)))


def street_of(location: Column) -> Column:
    return street_in(chunks_of(normalised(location)))


def signature(columns: list[tuple[Column, int | None]]) -> Column:
    """md5 of the parts, numbers rounded half to even at the given digits, missing ones as "missing"."""

    def part(c: Column, digits: int | None) -> Column:
        shown = c if digits is None else F.rint(c * 10**digits).cast("long").cast("string")
        return F.coalesce(shown, F.lit("missing"))

    return F.md5(F.concat_ws("|", *[part(c, d) for c, d in columns]))


def _has(text: Column, words: list[str]) -> Column:
    return reduce(or_, [text.contains(w) for w in words])


def text_flags(title: Column, description: Column, supplied: dict[str, Column] | None = None, lexicon: dict[str, list[str]] = C.KEYWORDS, negation: str = C.NEGATION) -> dict[str, Column]:
    """0/1 flags: a keyword that is left after negated ones are deleted; a supplied flag counts without text.

    Texts without a keyword, or without a word of the usual negation, are told by plain search; only the others meet the pattern.
    """
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit(""))))
    negated = _has(text, C.NEGATORS) if negation == C.NEGATION else F.lit(True)
    out = {}
    for flag, words in lexicon.items():
        any_word = "|".join(re.escape(w) for w in words)
        left = F.regexp_replace(text, f"(?U){negation}(?:{any_word})", "").rlike(any_word).cast("int")
        found = F.when(~_has(text, words), 0).when(~negated, 1).otherwise(left)
        given = (supplied or {}).get(flag)
        if given is not None:
            # the supplied number is cut to 0 .. 1, then truncated
            found = F.when((F.trim(text) == "") & given.isNotNull(), F.least(F.greatest(given.cast("double"), F.lit(0.0)), F.lit(1.0)).cast("int")).otherwise(found)
        out[flag] = found
    return out
