"""Scalar column helpers (SC1-SC18). All stay inside whole-stage codegen."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

GIB = 1024**3
DAY_SECONDS = 86400.0


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def clip(value: Column, low: float, high: float) -> Column:
    """SC1. Null stays null (``greatest``/``least`` alone would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def _scaled_half_even(value: Column, digits: int) -> Column:
    """``round(|value| * 10^digits)`` decided on the exact binary value.

    The double is split into a high part whose product with the power of ten is
    exact and a short rest, so the sign of the distance to the half-way point
    is never lost to rounding. Holds below 9e12; free of branches, so the
    repeated parts are computed once.
    """
    size = F.abs(value)
    power = F.lit(float(10**digits))
    whole = F.floor(size * power)
    spread = size * F.lit(2049.0)
    high = spread - (spread - size)
    past_half = (high * power - (whole + F.lit(0.5))) + (size - high) * power
    # An exact tie goes to the even neighbour.
    up = F.signum(past_half) + (whole % 2) * F.lit(0.5) > 0
    return whole + up.cast("long")


def round_exact(value: Column, digits: int = 3) -> Column:
    """SC2. Half-even rounding of the binary double (not of its decimal text)."""
    magnitude = _scaled_half_even(value, digits) / F.lit(float(10**digits))
    return magnitude * F.when(value < 0, -1.0).otherwise(1.0)


def fixed(value: Column, digits: int) -> Column:
    """SC18. Text with a fixed number of decimals, rounded like ``round_exact``."""
    unit = F.lit(Decimal(1).scaleb(-digits))
    text = (_scaled_half_even(value, digits).cast("decimal(18,0)") * unit).cast("string")
    return F.concat(F.when(value < 0, "-").otherwise(""), text)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def hours_between(later: Column, earlier: Column) -> Column:
    """SC4. Elapsed hours as a double."""
    return (micros(later) - micros(earlier)) / F.lit(3.6e9)


def plus_minutes(ts: Column, minutes: Column) -> Column:
    """SC4. Timestamp plus a whole number of minutes."""
    return F.timestamp_micros(micros(ts) + minutes.cast("long") * F.lit(60_000_000).cast("long"))


def age_days(as_of: Column, mtime: Column) -> Column:
    """SC8. Never negative."""
    return F.greatest(F.lit(0.0), (micros(as_of) - micros(mtime)) / F.lit(DAY_SECONDS * 1e6))


def bytes_from_pct(total_gb: Column, pct: Column) -> list[Column]:
    """PRJ2. total/used/free bytes from the unrounded percentage, plus the stored one."""
    total = (total_gb * F.lit(float(GIB))).cast("long")
    used = (total * (pct / F.lit(100.0))).cast("long")
    return [
        total.alias("total_bytes"),
        used.alias("used_bytes"),
        (total - used).alias("free_bytes"),
        round_exact(pct, 3).alias("in_use_pct"),
    ]


def bytes_to_gb(size: Column) -> Column:
    """PRJ3."""
    return round_exact(size / F.lit(float(GIB)), 2)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_under(path: Column, root: Column) -> Column:
    """SC9. The root itself or anything below it."""
    trimmed = F.rtrim(root, F.lit("/"))
    return (path == trimmed) | F.startswith(path, F.concat(trimmed, F.lit("/")))


def is_active_log(path: Column, age: Column) -> Column:
    """SC10. A live log: plain ``.log`` name without rotation marks, touched within a day."""
    name = basename(path)
    # Name parts that mark a rotated or archived log.
    rotated = [".log.1", ".log.2", "archive", "-old"]
    marked = reduce(lambda a, b: a | b, [F.contains(name, F.lit(part)) for part in rotated])
    return F.endswith(name, F.lit(".log")) & ~marked & (age < 1.0)


def glob_regex(glob: str) -> str:
    """SC7. Anchored regex for a shell name pattern with ``*``, ``?`` and ``[...]``."""
    specials = set("\\^$.|?*+()[]{}")
    out, rest = [], glob
    while rest:
        char, rest = rest[0], rest[1:]
        if char == "[" and "]" in rest[1:]:
            stop = rest.index("]", 1)
            members = rest[:stop].replace("\\", "\\\\")
            out.append("[" + ("^" + members[1:] if members.startswith("!") else members) + "]")
            rest = rest[stop + 1:]
        elif char == "*":
            out.append(".*")
        elif char == "?":
            out.append(".")
        else:
            out.append("\\" + char if char in specials else char)
    return "(?s)^" + "".join(out) + "$"


def short_id(prefix: str, *parts: Column) -> Column:
    """SC14. Stable identifier: same inputs, same id on every replay."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12))


def month_prefix(ts: Column) -> Column:
    """SC5. ``INC-yyyy-MM-``."""
    return F.concat(F.lit("INC-"), F.date_format(ts, "yyyy-MM"), F.lit("-"))


def id_sequence(ticket_id: Column) -> Column:
    """SC6. Trailing number of a month-prefixed ticket id."""
    return F.split_part(ticket_id, F.lit("-"), F.lit(4)).cast("int")


def numbered_id(prefix: Column, number: Column) -> Column:
    """SC5. At least four digits, longer numbers are kept whole."""
    digits = number.cast("string")
    return F.concat(prefix, F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))


def shown(value: Column) -> Column:
    """Text of a nullable value, null as ``None``."""
    return F.coalesce(value.cast("string"), F.lit("None"))
