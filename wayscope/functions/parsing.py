"""Numbers and times out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space around numbers and times.
_BLANK = r"[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
_NUMBER = rf"^{_BLANK}*([+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))"
_BLANKS = "\t\n\v\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
ISO_TIME = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?$"


def trimmed(text: Column) -> Column:
    """text without white space at both ends."""
    return F.btrim(text, F.lit(_BLANKS))


def parse_float(text: Column) -> Column:
    """The number that a text begins with, as double; null where it begins with none."""
    return F.regexp_extract(text, _NUMBER, 1).try_cast("double")


def epoch_ms(text: Column) -> Column:
    """Milliseconds since 1970 of an ISO 8601 date or date-time; null for any other text.

    Without an offset the text is taken as UTC. Other formats that some parsers take (month names, times without a date) are not read.
    """
    full = F.when(F.length(text) == 10, F.concat(text, F.lit("T00:00:00Z"))).when(text.rlike(r"(Z|[+-]\d{2}:\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.when(text.rlike(ISO_TIME), F.unix_millis(full.try_cast("timestamp")))


def clock(ms: Column, zone: str = "UTC") -> Column:
    """HH:MM:SS of an instant on the wall clock of zone, whatever the session's zone."""
    local = F.timestamp_millis(ms).cast("timestamp_ntz")
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit(zone), local), "HH:mm:ss")


def js_number(x: Column) -> Column:
    """A double as text in its shortest form: plain from 1e-6 to below 1e21, else with a power of ten; whole numbers without decimals."""
    size = F.abs(x)
    # Decimals of as many places as any double of that size has in its shortest form.
    plain = F.when(size < 1, x.try_cast("decimal(38,30)").cast("string")).otherwise(x.try_cast("decimal(38,17)").cast("string"))
    plain = F.regexp_replace(F.regexp_replace(plain, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    power = F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.0)?E(-?)", "e$2"), "e([0-9])", "e+$1")
    return F.when(x == 0, "0").when(F.isnan(x) | (size == F.lit(float("inf"))), x.cast("string")).when((size >= 1e-6) & (size < 1e21), plain).otherwise(power)


def fixed(x: Column, digits: int) -> Column:
    """A double as text with so many decimals (up to 6), rounded by its exact binary value, and up in size where that lies in the middle: 1.005 to two
    decimals is 1.00. What is too large for that has the decimals that its shortest form has."""
    scale = F.lit(float(10**digits))
    size = F.abs(x)
    # The product's rounding error, exactly: both halves of the number have few enough bits for their products to be exact.
    wide = size * F.lit(134217729.0)
    high = wide - (wide - size)
    product = size * scale
    error = (high * scale - product) + (size - high) * scale
    below = F.floor(product)
    up = (product - below.cast("double") - F.lit(0.5)) + error >= 0
    n = below + F.when(up, 1).otherwise(0)
    # Below 1e15 all whole numbers are exact as doubles.
    whole, part = F.floor(n / F.lit(10**digits)).cast("string"), F.lpad((n % 10**digits).cast("string"), digits, "0")
    text = F.concat(whole, F.lit("."), part) if digits else n.cast("string")
    plain = F.concat(F.when(x < 0, "-").otherwise(""), text)
    return F.when(F.isnan(x) | (size >= 1e15 / 10**digits), js_number(x)).otherwise(plain)
