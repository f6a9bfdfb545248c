"""Packed encodings to physical units and back, as Column expressions.

Nothing here leaves the JVM; every function takes and returns Columns, so it works in
projections, filters, aggregates and streams alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the wire formats
APERTURE_SENTINELS = (0xFFFD, 0xFFFE, 0xFFFF)
SHUTTER_BULB, SHUTTER_NOTHING = 0, 0xFFFFFFFF
ISO_AUTO = 0xFFFFFF
UNKNOWN_CAPACITY = 0xFFFFFFFFFFFFFFFF


def half_away(x: Column) -> Column:
    """Round to the nearest integer, halves away from zero."""
    return (F.signum(x) * F.floor(F.abs(x) + 0.5)).cast("long")


def aperture_encode(f: Column, truncate: bool = False) -> Column:
    """F-number to hundredths; ``truncate`` adds a half and cuts, the other rounds."""
    return F.floor(f * 100 + 0.5).cast("long") if truncate else half_away(f * 100)


def aperture_decode(v: Column, sentinels: bool = True) -> Column:
    """Hundredths to f-number; null for closed, unknown and nothing to show."""
    plain = v.cast("double") / 100
    return F.when(~v.isin(*APERTURE_SENTINELS), plain) if sentinels else plain


def shutter_encode(seconds: Column) -> Column:
    """Seconds to numerator and denominator in 16 bits each.

    Below a second, 1/N where that is within two percent, else tenths; 0 is Bulb.
    """
    den = half_away(1 / seconds)
    unit = (seconds < 1) & (den >= 1) & (F.abs(1 / den - seconds) <= seconds * 0.02)
    tenths = F.greatest(F.lit(1), F.least(F.lit(0xFFFF), half_away(seconds * 10)))
    return F.when(seconds <= 0, F.lit(SHUTTER_BULB).cast("long")).when(unit, F.lit(1 << 16).cast("long") + F.least(F.lit(0xFFFF), den)).otherwise(tenths.cast("long") * 65536 + 10)


def shutter_decode(v: Column) -> Column:
    """Packed value to seconds; null for Bulb, nothing to show and a zero denominator."""
    v = v.cast("long")
    num, den = F.shiftright(v, 16).bitwiseAND(0xFFFF), v.bitwiseAND(0xFFFF)
    return F.when((v != SHUTTER_BULB) & (v != SHUTTER_NOTHING) & (den != 0), num / den)


def duration_text(seconds: Column) -> Column:
    """A duration as hours, minutes and seconds, below a second in ms, µs or ns; cut after nanoseconds, trailing zeros go."""
    nanos = F.floor(seconds.cast("double") * 1_000_000_000)
    trimmed = lambda x: F.regexp_replace(F.regexp_replace(x, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    part = lambda unit, digits: trimmed(F.concat(F.floor(nanos / unit).cast("string"), F.lit("."), F.lpad((nanos % unit).cast("string"), digits, "0")))
    minutes, hours = F.floor(nanos / 60_000_000_000), F.floor(nanos / 3_600_000_000_000)
    rest = nanos % 60_000_000_000
    tail = trimmed(F.concat(F.floor(rest / 1_000_000_000).cast("string"), F.lit("."), F.lpad((rest % 1_000_000_000).cast("string"), 9, "0")))
    long = F.concat(F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h"))).otherwise(""), F.when(minutes > 0, F.concat((minutes % 60).cast("string"), F.lit("m"))).otherwise(""), tail, F.lit("s"))
    return F.when(nanos == 0, "0s").when(nanos < 1000, F.concat(nanos.cast("string"), F.lit("ns"))).when(nanos < 1_000_000, F.concat(part(1000, 3), F.lit("µs"))).when(nanos < 1_000_000_000, F.concat(part(1_000_000, 6), F.lit("ms"))).when(nanos > 0, long)


def shutter_micros_encode(seconds: Column) -> Column:
    """Seconds to a count of microseconds."""
    return half_away(seconds * 1_000_000)


def shutter_micros_decode(v: Column) -> Column:
    return v.cast("double") / 1_000_000


def shutter_valid(seconds: Column, least: float = 1 / 65535, most: float = 6553.5) -> Column:
    """Bulb (zero or less) is valid; otherwise the wire format's range holds."""
    return (seconds <= 0) | seconds.between(least, most)


def iso_encode(iso: Column, mode: Column) -> Column:
    """Sensitivity in 24 bits, mode in the next 8 (a 4-bit field would lose the extended mode)."""
    return iso.cast("long").bitwiseAND(0xFFFFFF) + F.shiftleft(mode.cast("long").bitwiseAND(0xFF), 24)


def iso_decode(v: Column) -> Column:
    """Struct of iso, mode and auto."""
    v = v.cast("long")
    iso = v.bitwiseAND(0xFFFFFF)
    return F.struct(iso.alias("iso"), F.shiftright(v, 24).bitwiseAND(0xFF).alias("mode"), (iso == ISO_AUTO).alias("auto"))


def ev_encode(ev: Column, truncate: bool = False) -> Column:
    """EV to signed thousandths; one vendor cuts towards zero, the other rounds."""
    return (ev * 1000).cast("long") if truncate else half_away(ev * 1000)


def ev_decode(v: Column) -> Column:
    return v.cast("long") / 1000


def sign_extend(v: Column, bits: int) -> Column:
    """The low bits of a value as a signed number."""
    low = v.cast("long").bitwiseAND((1 << bits) - 1)
    return F.when(low >= 1 << (bits - 1), low - (1 << bits)).otherwise(low)


def magnitude_extend(v: Column, bits: Column) -> Column:
    """Magnitude category and its bits to a signed difference, as in lossless JPEG."""
    full = F.pow(F.lit(2), bits).cast("long")
    return F.when(v >= full / 2, v).otherwise(v - full + 1)


def zigzag_decode(v: Column) -> Column:
    """0, 1, 2, 3, 4 to 0, -1, 1, -2, 2."""
    return F.when(v % 2 == 0, F.floor(v / 2)).otherwise(-F.floor((v + 1) / 2)).cast("long")


def quantise(d: Column, q1: int, q2: int, q3: int) -> Column:
    """A difference in nine levels, -4 to 4, by three thresholds."""
    a = F.abs(d)
    level = F.when(a == 0, 0).when(a < q1, 1).when(a < q2, 2).when(a < q3, 3).otherwise(4)
    return (F.signum(d) * level).cast("int")


def code_width(total: Column, count: Column) -> Column:
    """The least k for which count * 2**k reaches total, 15 at most; 0 for counts of 0 and below.  Integers throughout."""
    short = F.filter(F.array(*(F.shiftleft(count.cast("long"), k) for k in range(15))), lambda reached: reached < total)
    return F.when((count > 0) & (count < total), F.size(short)).otherwise(0).cast("int")


def tone_curve(v: Column, knots: list[int]) -> Column:
    """Piecewise linear expansion: each interval between knots doubles the step (identity without knots)."""
    if not knots:
        return v
    edges = [0, *knots, 4095]
    total, out = F.lit(0).cast("long"), v * 0
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        out = out + F.greatest(F.lit(0), F.least(v, F.lit(b)) - a) * (1 << k)
    return total + out


def nearest(choices: Column, want: Column, distance) -> Column:
    """The element of an array least distant from ``want``, the first among equals; ``want`` without choices.

    ``distance(element, want)`` may be null for elements that do not count.
    """
    scored = F.transform(choices, lambda x, i: F.struct(distance(x, want).alias("d"), i.alias("i"), x.alias("v")))
    return F.coalesce(F.array_min(F.filter(scored, lambda s: s["d"].isNotNull()))["v"], want)


def nearest_value(choices: Column, want: Column) -> Column:
    """By signed distance, so a set that spans zero is compared rightly."""
    return nearest(choices, want, lambda x, w: F.abs(x - w))


def nearest_shutter(choices: Column, seconds: Column) -> Column:
    """By ratio of durations; Bulb entries do not count."""
    ratio = lambda x, w: F.when(shutter_decode(x) > 0, F.greatest(shutter_decode(x) / w, w / shutter_decode(x)))
    return F.when(seconds > 0, nearest(choices, seconds, ratio)).otherwise(shutter_encode(seconds))


def pattern_at(pattern: Column, width: int, height: int, x: Column, y: Column) -> Column:
    """The colour under a pixel of a repeating mosaic."""
    return F.element_at(pattern, ((F.pmod(y, F.lit(height)) * width) + F.pmod(x, F.lit(width)) + 1).cast("int"))


def pattern_letters(pattern: Column) -> Column:
    """Colour codes 0, 1, 2 to R, G, B; anything else to a question mark."""
    return F.array_join(F.transform(pattern, lambda c: F.when(c == 0, "R").when(c == 1, "G").when(c == 2, "B").otherwise("?")), "")


# --- text and time ---------------------------------------------------------------


def hex_label(kind: str, code: Column) -> Column:
    """Fallback name of an unknown code."""
    return F.format_string(f"{kind}(0x%04X)", code.cast("int"))


def hex_list(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda c: F.format_string("0x%04X", c.cast("int"))), " ")


def printable_runs(data: Column, least: int = 4) -> Column:
    """Runs of printable ASCII bytes."""
    return F.regexp_extract_all(F.decode(data, "ISO-8859-1"), F.lit(f"[\\x20-\\x7E]{{{least},}}"), F.lit(0))


def first_names(names: Column, most: int) -> Column:
    """Up to ``most`` names, comma-joined, then how many more."""
    more = F.size(names) - most
    return F.concat(F.array_join(F.slice(names, 1, most), ", "), F.when(more > 0, F.concat(F.lit(" ("), more.cast("string"), F.lit(" more)"))).otherwise(""))


def parse_assignment(text: Column) -> Column:
    """``CODE=VALUE`` with hex or decimal numbers on both sides, or a name on the left."""
    left, right = F.trim(F.split_part(text, F.lit("="), F.lit(1))), F.trim(F.split_part(text, F.lit("="), F.lit(2)))
    number = lambda s: F.when(F.lower(s).startswith("0x"), F.conv(F.substr(s, F.lit(3)), 16, 10).cast("long")).otherwise(s.try_cast("long"))
    return F.struct(number(left).alias("code"), F.when(number(left).isNull(), left).alias("name"), number(right).alias("value"))


LAYOUTS = ("yyyyMMdd'T'HHmmssXX", "yyyyMMdd'T'HHmmssXXX", "yyyyMMdd'T'HHmmss", "yyyyMMdd'T'HHmm")


def date_time(text: Column) -> Column:
    """Camera date-times, with or without zone, fraction and seconds; null where none fits."""
    whole = F.regexp_replace(text, r"\.\d+", "")
    zoned = F.regexp_replace(whole, "Z$", "+0000")
    digits = F.regexp_extract(text, r"\.(\d+)", 1)
    seconds = F.coalesce(*(F.try_to_timestamp(zoned, F.lit(p)) for p in LAYOUTS))
    micros = F.when(digits != "", F.rpad(F.substring(digits, 1, 6), 6, "0").cast("long")).otherwise(0)
    return F.timestamp_micros(F.unix_micros(seconds) + micros)


def date_time_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss")


def next_minute(ts: Column) -> Column:
    return F.date_trunc("minute", ts) + F.expr("INTERVAL 1 MINUTE")
