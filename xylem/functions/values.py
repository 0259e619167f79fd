"""Text, number and pattern rules as column expressions; all stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER_PREFIX = r"^[\s]*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def parse_float(x: Column) -> Column:
    """XP37: the longest numeric prefix as a double, else null: '12abc' is 12, '007' is 7."""
    return F.regexp_extract(x, NUMBER_PREFIX, 1).try_cast("double")


def number_text(x: Column) -> Column:
    """A double as text: whole numbers without a fraction, NaN and Infinity by name, no exponent below 1e15."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.17f", F.round(x, 15)), r"0+$", ""), r"\.$", "")
    short = F.when(x.cast("string").contains("E"), plain).otherwise(x.cast("string"))
    return (
        F.when(x.isNull() | F.isnan(x), F.lit("NaN")).when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity")
        .when(whole, x.cast("long").cast("string")).otherwise(short)
    )


def typed_number(text: Column) -> Column:
    """IO02, IO10: a text's number if it is written as one: no exponent, no plus sign, no leading zero before digits."""
    fits = text.rlike(r"\A-?\d+(\.\d+)?\z") & ~text.rlike(r"\A0\d")
    return F.when(fits, text.try_cast("double"))


def typed_boolean(text: Column) -> Column:
    """IO02: true or false, in any case."""
    return F.when(F.lower(text).isin("true", "false"), F.lower(text) == "true")


def trim_all(x: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")


def glob(pattern: str) -> str:
    """A glob with * as the only wildcard, as an anchored pattern that ignores case."""
    return r"(?is)\A" + ".*".join(re.escape(p) for p in pattern.split("*")) + r"\z"


def like(x: Column, pattern: str | re.Pattern) -> Column:
    """Matches a glob (text) or searches for a regular expression."""
    if isinstance(pattern, str):
        return x.rlike(glob(pattern))
    flags = "i" * bool(pattern.flags & re.I) + "s" * bool(pattern.flags & re.S) + "m" * bool(pattern.flags & re.M)
    return x.rlike((f"(?{flags})" if flags else "") + re.sub(r"(?<!\\)\$$", r"\\z", pattern.pattern))


def text_or_empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


# Scalar functions of path expressions. Columns themselves are XP20 and XP23 (&, |, ~), XP40 (text, name, local_name), XP41
# to XP43 (contains, startswith, endswith), XP45 (F.lit) and the rest of XP38 (F.floor, F.ceil) -----------------------------------------------------------------------------

def string_length(x: Column) -> Column:
    """XP30: length in UTF-16 units."""
    return (F.octet_length(F.encode(text_or_empty(x), "UTF-16LE")) / 2).cast("int")


def normalize_space(x: Column) -> Column:
    """XP31."""
    return trim_all(F.regexp_replace(text_or_empty(x), r"(?U)\s+", " "))


def substring(x: Column, start, length=None) -> Column:
    """XP32: characters from a 1-based start. A start below 1 counts from 1 but the end stays start + length; a negative
    length swaps the ends."""
    x, start = text_or_empty(x), F.lit(start).cast("int")
    first = F.greatest(start - 1, F.lit(0))
    last = F.char_length(x) if length is None else F.greatest(start - 1 + F.lit(length).cast("int"), F.lit(0))
    lo, hi = F.least(first, last), F.greatest(first, last)
    return F.substr(x, lo + 1, F.least(hi, F.char_length(x)) - F.least(lo, F.char_length(x)))


def concat(*xs: Column) -> Column:
    """XP33: null counts as empty."""
    return F.concat(*[text_or_empty(x) for x in xs])


def translate_in_turn(x: Column, source: str, target: str) -> Column:
    """XP34: one character after another: a result of an earlier replacement can be replaced again."""
    for i, c in enumerate(source):
        x = F.replace(x, F.lit(c), F.lit(target[i] if i < len(target) else ""))
    return x


def substring_before(x: Column, mark: str) -> Column:
    """XP35: empty where the mark is absent."""
    at = F.instr(text_or_empty(x), mark)
    return F.when(at > 0, F.substr(x, F.lit(1), at - 1)).otherwise("")


def substring_after(x: Column, mark: str) -> Column:
    """XP36: empty where the mark is absent."""
    at = F.instr(text_or_empty(x), mark)
    return F.when(at > 0, F.substr(x, at + len(mark))).otherwise("")


def number(x: Column) -> Column:
    """XP37: NaN for what begins with no number."""
    return F.coalesce(parse_float(x), F.lit(float("nan")))


def round_half_up(x: Column) -> Column:
    """XP38: halves go towards plus infinity."""
    return F.floor(x + 0.5).cast("double")


def divide(a: Column, b: Column) -> Column:
    """XP27: division by zero gives an infinity, or NaN for zero by zero."""
    zero = F.when((a == 0) | F.isnan(a), float("nan")).when(a > 0, float("inf")).otherwise(float("-inf"))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def modulo(a: Column, b: Column) -> Column:
    """XP27: the sign is that of the dividend; NaN for a divisor of zero."""
    return F.when(b == 0, float("nan")).otherwise(F.try_mod(a, b))


def compare(left: Column, op: str, right: Column) -> Column:
    """XP24: = and != compare texts; order compares numbers if both sides begin with one, else texts."""
    left, right = text_or_empty(left.cast("string")), text_or_empty(right.cast("string"))
    if op in ("=", "!="):
        return left == right if op == "=" else left != right
    a, b = parse_float(left), parse_float(right)
    order = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    return F.when(a.isNotNull() & b.isNotNull(), order(a, b)).otherwise(order(left, right))


def truth(x: Column) -> Column:
    """XP45: whether a text is neither empty nor NaN."""
    return (text_or_empty(x) != "") & (x != "NaN")


def lang_is(lang: Column, code: str) -> Column:
    """XP44: whether an inherited language is this code or one of its variants."""
    low = F.lower(lang)
    return F.coalesce((low == code.lower()) | low.startswith(code.lower() + "-"), F.lit(False))


# Escapes ----------------------------------------------------------------------------------------------------------

def _in_turn(x: Column, pairs) -> Column:
    for a, b in pairs:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


TEXT_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")]


def escape_text(x: Column) -> Column:
    """IO13: for text."""
    return _in_turn(text_or_empty(x.cast("string")), TEXT_ESCAPES)


def escape_attribute(x: Column) -> Column:
    """IO13: for attribute values."""
    return _in_turn(escape_text(x), [("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;")])


def escape_cdata(x: Column) -> Column:
    """IO13: for CDATA sections."""
    return _in_turn(text_or_empty(x), [("]]>", "]]]]><![CDATA[>")])


def escape_comment(x: Column) -> Column:
    """IO13: for comments."""
    return _in_turn(text_or_empty(x), [("--", "- -")])
