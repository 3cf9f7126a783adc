"""Scalar text rules (N1-N7) as native Spark expressions.

All functions take and return ``Column`` objects so they stay inside
whole-stage codegen; none of them crosses into Python.
"""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode white-space set stripped by "trim space"
# (Unicode White_Space property): TAB, LF, VT, FF, CR, SPACE, NEL, NBSP,
# OGHAM SPACE MARK, EN QUAD .. HAIR SPACE, LINE SEPARATOR, PARAGRAPH
# SEPARATOR, NARROW NBSP, MEDIUM MATHEMATICAL SPACE, IDEOGRAPHIC SPACE.
UNICODE_SPACE = ("\t\n\x0b\x0c\r \x85\xa0\u1680"
                 "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                 "\u2028\u2029\u202f\u205f\u3000")

# Rating words and their numbers (case-sensitive lookup).
RATING_WORDS = {"Zero": 0, "One": 1, "Two": 2, "Three": 3, "Four": 4, "Five": 5}

# The currency sign removed from prices.
CURRENCY_SIGN = "£"

# Named character references (the HTML 4 set and &apos;), from the standard library's table; the usual ones
# come first, as a map is searched in order.
_USUAL = ("amp", "lt", "gt", "quot", "nbsp", "pound", "euro")
NAMED_REFERENCES = {**{n: chr(name2codepoint[n]) for n in _USUAL}, "apos": "'", **{n: chr(c) for n, c in name2codepoint.items()}}

# Numeric references 128-159 stand for Windows-1252 characters where that code page has one.
WINDOWS_REFERENCES = {c: ord(t) for c in range(128, 160) if (t := bytes([c]).decode("cp1252", "ignore"))}


# A start or end tag; quoted attribute values may hold ">".  Runs of characters are greedy inside a possessive
# group, which gives nothing back either: the engine runs over them in a loop of its own.
TAG_BODY = r"""(?:[^>"']+|"[^"]*"|'[^']*')*+"""
TAG = rf"</?[A-Za-z]{TAG_BODY}>"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def non_empty(value: Column) -> Column:
    """``value``, or NULL for an empty string; unlike ``nullif``, computed once inside arrays too."""
    return let(value, lambda s: F.when(s != "", s))


def text(c) -> Column:
    """NULL-safe string: a missing value is the empty string."""
    return F.coalesce(_c(c), F.lit(""))


def trim_ws(c) -> Column:
    """Strip all Unicode white space at both ends (SQL ``trim`` strips
    only U+0020)."""
    return F.trim(text(c), F.lit(UNICODE_SPACE))


def is_blank(c) -> Column:
    return trim_ws(c) == F.lit("")


def normalize_price(c) -> Column:
    """Trim, delete every currency sign, trim again."""
    return trim_ws(F.replace(trim_ws(c), F.lit(CURRENCY_SIGN), F.lit("")))


def parse_price(c) -> Column:
    """Keep ASCII digits and '.', parse as double; NULL on any error
    (empty, lone '.', two dots, out of range)."""
    digits = F.regexp_replace(text(c), r"[^0-9.]", "")
    d = digits.try_cast("double")
    return F.when(F.abs(d) == F.lit(float("inf")), F.lit(None).cast("double")).otherwise(d)


def normalize_availability(c) -> Column:
    """Trim only."""
    return trim_ws(c)


def rating_to_numeric(c) -> Column:
    """Case-sensitive word lookup on the trimmed text; anything else 0."""
    m = F.create_map(*[x for k, v in RATING_WORDS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, trim_ws(c)), F.lit(0)).cast("int")


def format_rfc3339(c) -> Column:
    """RFC 3339 with seconds precision and offset (``Z`` in UTC)."""
    return F.date_format(_c(c).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssXXX")


def format_2dp(c) -> Column:
    """Fixed two decimals of the exact binary value, ties to even."""
    return F.call_function("format_number", _c(c).cast("double"), F.lit("0.00"))


def _numeric_reference(ref: Column) -> Column:
    """The character of ``#163`` or ``#xA3``.

    Leading zeros do not count; zero, surrogates and numbers beyond Unicode
    give U+FFFD, as in HTML.
    """
    digits = F.regexp_extract(ref, r"^#[xX]?0*([0-9A-Fa-f]*)\z", 1)
    base_hex = F.lower(F.substring(ref, 2, 1)) == "x"
    # seven digits hold every code point in either base; conv never sees more
    short = let(digits, lambda d: F.when(F.length(d).between(1, 7), d).otherwise(F.lit("0")))
    number = F.when(base_hex, F.conv(short, 16, 10)).otherwise(short).cast("long")
    windows = F.expr(f"map({', '.join(f'{a}L, {b}L' for a, b in WINDOWS_REFERENCES.items())})")

    def character(code: Column) -> Column:
        bad = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        known = F.when(code.between(128, 159), F.coalesce(F.try_element_at(windows, code), code)).otherwise(code)
        valid = F.when(bad, F.lit(0xFFFD).cast("long")).otherwise(known)
        one_byte = code.between(1, 127) | code.between(160, 255)
        return F.when(one_byte, F.chr(code)).otherwise(F.decode(F.unhex(F.lpad(F.hex(valid), 8, "0")), "UTF-32"))

    return let(number, character)


def decode_entities(c) -> Column:
    """Decode named and numeric character references, all in one pass, so
    that ``&amp;lt;`` and ``&#38;lt;`` both give the text ``&lt;``.  Unknown
    names stay as they are; text without ``&`` is returned untouched."""
    names = F.from_json(F.lit(json.dumps(NAMED_REFERENCES)), "map<string,string>")  # one call to build, folded to a literal

    def one(t: Column) -> Column:
        """What follows an ampersand, with the reference that begins it decoded."""
        # the name up to the semicolon; a name of the table needs no other test
        def decoded(name: Column) -> Column:
            known = F.when(name.rlike(r"^#(?:[xX][0-9A-Fa-f]+|[0-9]+)\z"), _numeric_reference(name)) \
                .when(~name.startswith("#"), F.try_element_at(names, name))
            return F.when(F.length(name) < F.length(t), F.concat(known, F.substring(t, F.length(name) + 2, F.length(t))))

        return F.coalesce(let(F.substring_index(t, ";", 1), decoded), F.concat(F.lit("&"), t))

    def whole(pieces: Column) -> Column:
        return F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), one), ""))

    return let(text(c), lambda s: F.when(F.instr(s, "&") > 0, let(F.split(s, "&", -1), whole)).otherwise(s))


def strip_tags(c) -> Column:
    """Text content of an HTML fragment: tags removed (a ``>`` inside a quoted
    attribute does not end one), references decoded."""
    return decode_entities(F.regexp_replace(text(c), TAG, ""))
