"""Functions of numbers, times and versions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(c: Column) -> Column:
    """Halves go up, below zero as well."""
    return F.floor(c + 0.5)


def one_digit(c: Column, to_even: bool = False) -> Column:
    """A number from 0 on with one digit after the point. The exact binary value is
    rounded, halves up, so 358.65, which is stored as a bit less, gives 358.6. With
    ``to_even`` halves go to the even digit, as printf has it: 1.25 gives 1.2.

    The fraction is split in two parts of few bits, so that twenty times either is
    exact and no rounding of its own can move a value over a half.
    """
    c = c.cast("double")
    whole = F.floor(c)
    part = c - whole
    high = F.floor(part * 67_108_864) / 67_108_864
    low = part - high
    over = lambda k: (high * 20 - (2 * k + 1)) + low * 20
    tenths = sum((F.when(over(k) > 0 if to_even and k % 2 == 0 else over(k) >= 0, 1).otherwise(0) for k in range(10)), F.lit(0))
    total = whole * 10 + tenths
    return F.concat(F.floor(total / 10).cast("string"), F.lit("."), F.pmod(total, F.lit(10)).cast("string"))


def clamp(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def time_difference(a: Column, b: Column) -> Column:
    """The span between two times in its largest whole unit."""
    seconds = F.floor(F.abs(F.unix_micros(b) - F.unix_micros(a)) / 1_000_000)
    out = None
    for below, size, name in ((60, 1, "second"), (3600, 60, "minute"), (86400, 3600, "hour"), (31536000, 86400, "day"), (None, 31536000, "year")):
        n = F.floor(seconds / size).cast("long")
        said = F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s"))
        out = F.when(seconds < below, said) if out is None else out.when(seconds < below, said) if below else out.otherwise(said)
    return out


def badge(score: Column, high: int, low: int) -> Column:
    """struct(percent, colour) of a score."""
    p = js_round(score * 100).cast("long")
    return F.struct(p.alias("percent"), F.when(p >= high, "green").when(p >= low, "amber").otherwise("grey").alias("colour"))


def size_text(gb: Column) -> Column:
    return F.when(gb >= 1, F.concat(one_digit(gb), F.lit(" GB"))).when(gb > 0, F.concat(js_round(gb * 1024).cast("string"), F.lit(" MB")))


def count_text(n: Column, thousands: bool = True, to_even: bool = False) -> Column:
    """A count in millions or thousands with one digit after the point."""
    out = F.when(n >= 1_000_000, F.concat(one_digit(n / 1_000_000, to_even), F.lit("M")))
    if thousands:
        out = out.when(n >= 1_000, F.concat(one_digit(n / 1_000, to_even), F.lit("K")))
    return out.otherwise(n.cast("string"))


def parameter_text(n: Column) -> Column:
    return (
        F.when(n >= 1_000_000_000, F.concat(one_digit(n / 1_000_000_000), F.lit("B")))
        .when(n >= 1_000_000, F.concat(js_round(n / 1_000_000).cast("string"), F.lit("M")))
        .when(n > 0, F.format_number(n, 0))
    )


def context_text(n: Column, millions: bool = True) -> Column:
    thousands = F.when(n >= 1_000, F.concat(js_round(n / 1_000).cast("string"), F.lit("K"))).when(n > 0, n.cast("string"))
    return F.when(n >= 1_000_000, F.concat(one_digit(n / 1_000_000), F.lit("M"))).otherwise(thousands) if millions else thousands


def rgb(colour: Column) -> Column:
    """Three numbers from 0 to 1 of a #rrggbb colour."""
    return F.array(*(F.conv(F.substring(colour, a, 2), 16, 10).cast("double") / 255 for a in (2, 4, 6)))


def version_number(c: Column) -> Column:
    """Ten times the major number plus the minor one; null for what is no version."""
    part = F.split(c, r"\.")
    return F.try_element_at(part, F.lit(1)).try_cast("int") * 10 + F.coalesce(F.try_element_at(part, F.lit(2)).try_cast("int"), F.lit(0))


def line_chunks(content: Column, lines: int = 1000) -> Column:
    """The text in parts of so many lines. One of fewer characters has no second part."""
    all_lines = F.split(content, "\n", -1)
    starts = F.sequence(F.lit(0), F.size(all_lines) - 1, F.lit(lines))
    parts = F.transform(starts, lambda i: F.array_join(F.slice(all_lines, i + 1, F.lit(lines)), "\n"))
    return F.when(F.length(content) < lines, F.array(content)).otherwise(parts)


def short_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def still_valid(fetched_ms: Column, now_ms: Column, days: int = 90) -> Column:
    return now_ms - fetched_ms <= days * 86_400_000
