"""Text normalisation and small string scalars."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from doctriage import fixed
from doctriage.functions.regex import bind, split_by

# White space as str.split/strip see it: Unicode white space plus the four
# information separators.  The range before && settles common letters quickly.
_HIGH_SPACE = r"[ -　&&[  -     　]]"
_ODD_SPACE = rf"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0{_HIGH_SPACE}]"
_SPACE = rf"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0{_HIGH_SPACE}]"
# A run that is not already one plain blank: single blanks are left alone,
# which is what most of a text consists of.
_SPACE_RUN = rf"{_ODD_SPACE}{_SPACE}*| {_SPACE}+"


# Hangul syllables are composed by arithmetic: leading consonant, vowel, trailing consonant or none.
_HANGUL_FIRST, _HANGUL_LAST, _VOWELS, _TRAILS = 0xAC00, 0xD7A3, 21, 28


@lru_cache(maxsize=1)
def _decompositions() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility decomposition without combining marks differs from them.

    The first table holds those that become one character or none, the second
    those that become several; Hangul syllables are left to arithmetic.
    """
    single, several = {}, {}
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if 0xD800 <= code <= 0xDFFF or _HANGUL_FIRST <= code <= _HANGUL_LAST:
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if plain != char:
            (single if len(plain) < 2 else several)[char] = plain
    return single, several


def _char_class(chars: list[str]) -> str:
    ranges: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges)


@lru_cache(maxsize=1)
def _strip_tables() -> tuple[str, str, str, str, str]:
    single, several = _decompositions()
    kept = [c for c in single if single[c]]
    gone = [c for c in single if not single[c]]
    keys = sorted(several)
    hangul = rf"\x{{{_HANGUL_FIRST:x}}}-\x{{{_HANGUL_LAST:x}}}"
    # The leading ranges settle common letters without walking the list.
    several_class = rf"[\x{{a8}}-\x{{10ffff}}&&[{_char_class(keys)}{hangul}]]"
    return "".join(kept + gone), "".join(single[c] for c in kept), several_class, "".join(keys), "\n".join(several[k] for k in keys)


def _several(char: Column) -> Column:
    """What one of the characters that become several is made of."""
    _, _, _, keys, values = _strip_tables()
    at = F.ascii(char) - _HANGUL_FIRST

    def jamo(first: int, count: int, place: Column) -> Column:
        return F.substr(F.lit("".join(chr(first + i) for i in range(count))), place + 1, F.lit(1))

    syllable = F.concat(
        jamo(0x1100, 19, F.floor(at / (_VOWELS * _TRAILS)).cast("int")),
        jamo(0x1161, _VOWELS, F.floor(F.pmod(at, F.lit(_VOWELS * _TRAILS)) / _TRAILS).cast("int")),
        F.when(F.pmod(at, F.lit(_TRAILS)) > 0, jamo(0x11A7, _TRAILS, F.pmod(at, F.lit(_TRAILS)).cast("int"))).otherwise(""),
    )
    place = F.instr(F.lit(keys), char)
    listed = F.get(F.split(F.lit(values), "\n"), place - 1)
    return (
        F.when(char == "", "")
        .when((at >= 0) & (at <= _HANGUL_LAST - _HANGUL_FIRST), syllable)
        .when(place > 0, listed)
        .otherwise(char)
    )


def collapse_spaces(text: Column) -> Column:
    """Runs of white space become one blank; none at the ends.

    Line ends and tabs are swapped for blanks bytewise, which leaves most texts
    with nothing for the (much slower) pattern to do.
    """

    def tidy(flat: Column) -> Column:
        untidy = F.contains(flat, F.lit("  ")) | (flat.rlike("[^ -~]") & flat.rlike(_ODD_SPACE))
        return F.trim(F.when(untidy, F.regexp_replace(flat, _SPACE_RUN, " ")).otherwise(flat))

    flat = text
    for char in ("\r\n", "\n", "\t"):
        flat = F.replace(flat, F.lit(char), F.lit(" "))
    return bind(flat, tidy)


def strip_accents(text: Column) -> Column:
    """Compatibility decomposition without combining marks.

    Marks are dropped, so their order does not matter and every character decomposes by
    itself.  Pure ASCII (as many bytes as characters) needs nothing, most
    other texts a table of single characters; the rest goes character by
    character.  All of it is deterministic, so filters on other columns pass below it.
    """
    before, after, several, _, _ = _strip_tables()
    ascii_only = F.octet_length(text) == F.length(text)

    def finish(plain: Column) -> Column:
        # Pieces begin with a character that becomes several, so most of a text is copied whole.
        pieces = split_by(plain, f"(?={several})")
        done = F.transform(pieces, lambda p: F.concat(_several(F.left(p, F.lit(1))), F.substr(p, F.lit(2))))
        return F.when(plain.rlike(several), F.array_join(done, "")).otherwise(plain)

    translated = F.translate(text, before, after)
    return F.when(ascii_only, text).otherwise(bind(translated, finish))


def normalize_text(text: Column) -> Column:
    """Lower-case, accent-free, single-blank form of a text; '' for NULL."""
    return collapse_spaces(F.lower(strip_accents(F.coalesce(text, F.lit("")))))


def count_literal(text: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal, as DOUBLE.

    Byte lengths are stored with every string, so they cost nothing; the
    replacement only happens for texts that contain the literal.
    """
    if literal == "":
        return (F.length(text) + 1).cast("double")
    removed = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(literal), F.lit("")))
    hits = (removed / F.lit(len(literal.encode("utf-8")))).cast("double")
    return F.when(F.contains(text, F.lit(literal)), hits).otherwise(F.lit(0.0))


def sanitize_filename(name: Column, max_length: int = fixed.MAX_NAME_LENGTH) -> Column:
    """A name without illegal characters, outer dots/blanks or excess length."""
    clean = collapse_spaces(F.regexp_replace(F.coalesce(name, F.lit("")), fixed.ILLEGAL_NAME_CHARS, "_"))
    return F.left(F.btrim(clean, F.lit(". ")), F.lit(max_length))


def normalized_path(path: Column) -> Column:
    """One spelling for paths that name the same file: no '//' (but a scheme's), no '/./', no './' in front."""
    joined = F.regexp_replace(path, "(?<!^[A-Za-z][A-Za-z0-9+.-]{0,30}:/?)/{2,}", "/")
    tidied = F.regexp_replace(F.regexp_replace(joined, r"(?<=/)(?:\./)+", ""), r"^(?:\./)+(?=.)", "")
    # Most paths have nothing to tidy, and looking for it literally costs next to nothing.
    untidy = F.contains(path, F.lit("//")) | F.contains(path, F.lit("./"))
    return F.when(untidy, tidied).otherwise(path)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def merge_errors(*errors: Column) -> Column:
    """Non-empty error messages joined in order, NULL if there are none."""
    present = F.filter(F.array(*errors), lambda e: F.coalesce(e, F.lit("")) != "")
    return bind(F.array_join(present, fixed.ERROR_SEPARATOR), lambda e: F.when(e != "", e))


def number_text(value: Column) -> Column:
    """A double in plain notation ('12345678.9', never '1.23456789E7')."""
    plain = F.regexp_replace(value.cast("decimal(38,6)").cast("string"), r"0+$", "")
    return F.when(F.abs(value) < 1e7, value.cast("string")).otherwise(
        F.regexp_replace(plain, r"\.$", ".0")
    )
