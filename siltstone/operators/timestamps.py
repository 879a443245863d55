"""Mixed timestamp texts to one UTC instant: an ordered cascade of anchored patterns, parsed strictly.

Every pattern is anchored at both ends and yields date and time fields, a fraction and perhaps a
zone; the first pattern that matches decides. A zone in the text holds; otherwise the source's
default clock from a lookup. Fields out of range, a weekday that contradicts the date, and readings
on an unknown clock give null.

Policy for local times of a zone: a reading the zone skips gives null; one that occurs twice means
the instant less than an hour before the time of receipt, and gives null where neither is. An
instant after the time of receipt gives null. Without a time of receipt, a missing year and a reading
that occurs twice give null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.keys import trimmed

SECOND_US = 1_000_000
HOUR_US = 3_600 * SECOND_US
DAY_US = 86_400 * SECOND_US
FILETIME_TO_UNIX_US = 11_644_473_600 * SECOND_US

# Abbreviations of zones, in minutes east of UTC.
ZONE_MINUTES = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0,
    "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600,
    "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480, "NZST": 720, "NZDT": 780, "JST": 540, "KST": 540, "SGT": 480, "HKT": 480,
}
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")

_ZONE = r"(Z|[+-]\d{2}:?\d{2}|[A-Z]{2,4})"
_CLOCK = r"(\d{2}):(\d{2}):(\d{2})(?:[.,](\d{1,9}))?"


@dataclass(frozen=True)
class Pattern:
    """An anchored pattern (matched in upper case) and the fields its groups hold, in order."""

    name: str
    regex: str
    groups: tuple[str, ...]


#: The cascade. Groups: y m d (numbers), mon (month name), wd (weekday), a b (slash date, order by
#: source), h mi s f (fraction), ap (AM/PM), z (zone), off (minutes east of UTC, three digits).
PATTERNS = (
    Pattern("iso", rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[T ]{_CLOCK} ?{_ZONE}?$", ("y", "m", "d", "h", "mi", "s", "f", "z")),
    Pattern("iso_minute", rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[T ](\d{{2}}):(\d{{2}}) ?{_ZONE}?$", ("y", "m", "d", "h", "mi", "z")),
    Pattern("dotted", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}) {_CLOCK} ?{_ZONE}?$", ("d", "m", "y", "h", "mi", "s", "f", "z")),
    Pattern("slashed", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}) {_CLOCK}(?: ?(AM|PM))?(?: ?{_ZONE})?$", ("a", "b", "y", "h", "mi", "s", "f", "ap", "z")),
    Pattern("log", rf"^(\d{{2}})/([A-Z]{{3}})/(\d{{4}}):{_CLOCK} ?{_ZONE}?$", ("d", "mon", "y", "h", "mi", "s", "f", "z")),
    Pattern("mail", rf"^(?:([A-Z]{{3}}), ?)?(\d{{1,2}}) ([A-Z]{{3}}) (\d{{4}}) {_CLOCK} ?{_ZONE}?$", ("wd", "d", "mon", "y", "h", "mi", "s", "f", "z")),
    Pattern("compact", rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d{{1,9}}))?{_ZONE}?$", ("y", "m", "d", "h", "mi", "s", "f", "z")),
    Pattern("cim", r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})\.(\d{6})([+-]\d{3})$", ("y", "m", "d", "h", "mi", "s", "f", "off")),
    Pattern("syslog", rf"^([A-Z]{{3}}) {{1,2}}(\d{{1,2}}) {_CLOCK} ?{_ZONE}?$", ("mon", "d", "h", "mi", "s", "f", "z")),
)
FIELDS = ("y", "m", "d", "mon", "wd", "a", "b", "h", "mi", "s", "f", "ap", "z", "off")


def _fields(text: Column) -> Column:
    """Array of the pattern's name and the FIELDS of the first pattern that matches, null if none does."""
    out = None
    for p in PATTERNS:
        row = "|".join([p.name, *(f"${p.groups.index(f) + 1}" if f in p.groups else "" for f in FIELDS)])
        line = F.regexp_replace(text, p.regex, row)
        out = F.when(text.rlike(p.regex), line) if out is None else out.when(text.rlike(p.regex), line)
    return F.split(out, r"\|")


def _lookup(names: tuple[str, ...], value: Column) -> Column:
    """One-based place of a name, null if it is none of them."""
    return F.nullif(F.array_position(F.array(*map(F.lit, names)), value), F.lit(0).cast("bigint")).cast("int")


def number_instant(text: Column) -> Column:
    """Microseconds of a bare number: seconds (with a fraction), ms, us, ns or 100 ns since 1601, by length."""
    whole = F.try_to_number(F.when(text.rlike(r"^\d{1,19}$"), text), F.lit("9" * 19)).cast("bigint")
    cut = F.concat(F.regexp_extract(text, r"^(\d{9,10})\.", 1), F.rpad(F.substring(F.regexp_extract(text, r"\.(\d{1,9})$", 1), 1, 6), 6, "0"))
    size = F.length(text)
    return (
        F.when(text.rlike(r"^\d{9,10}$"), whole * F.lit(SECOND_US))
        .when(text.rlike(r"^\d{9,10}\.\d{1,9}$"), F.when(size > 0, cut.try_cast("bigint")))
        .when(text.rlike(r"^\d{12,13}$"), whole * F.lit(1000))
        .when(text.rlike(r"^\d{15,16}$"), whole)
        .when(text.rlike(r"^1\d{17}$"), F.substring(text, 1, 17).try_cast("bigint") - F.lit(FILETIME_TO_UNIX_US))
        .when(text.rlike(r"^1\d{18}$"), F.substring(text, 1, 16).try_cast("bigint"))
    )


def clock_zone(notation: Column) -> Column:
    """A clock notation as '+HH:MM[:SS]' or a region name, null if it is neither.

    Read are +HH:MM, +HHMM, UTC or GMT with or without an offset, seconds, an ISO duration, a day and
    time difference ('-1 day, 20:00:00') and region names.
    """
    text = trimmed(notation)
    upper = F.upper(text)

    def part(regex: str, i: int) -> Column:
        return F.coalesce(F.regexp_extract(upper, regex, i).try_cast("bigint"), F.lit(0).cast("bigint"))

    offset = r"^(?:UTC|GMT)? ?([+-])(\d{1,2}):?(\d{2})?(?::(\d{2}))?$"
    iso = r"^([+-]?)PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?$"
    diff = r"^(?:([+-]?\d+) DAYS?, ?)?(\d{1,2}):(\d{2}):(\d{2})$"

    def signed(regex: str) -> Column:
        return F.when(F.regexp_extract(upper, regex, 1) == "-", -1).otherwise(1) * (part(regex, 2) * 3600 + part(regex, 3) * 60 + part(regex, 4))

    seconds = (
        F.when(upper.isin("UTC", "GMT", "Z", "UT"), F.lit(0).cast("bigint"))
        .when(upper.rlike(r"^[+-]?\d{3,6}$") & ~upper.rlike(r"^[+-]\d{4}$"), upper.try_cast("bigint"))
        .when(upper == "0", F.lit(0).cast("bigint"))
        .when(upper.rlike(offset), signed(offset))
        .when(upper.rlike(iso), signed(iso))
        .when(upper.rlike(diff), part(diff, 1) * 86400 + part(diff, 2) * 3600 + part(diff, 3) * 60 + part(diff, 4))
    )
    size = F.abs(seconds)
    shown = F.concat(F.when(seconds < 0, "-").otherwise("+"), F.format_string("%02d:%02d", (size / 3600).cast("bigint"), (size / 60).cast("bigint") % 60))
    region = F.when(text.rlike(r"^[A-Za-z_]+(?:/[A-Za-z_+-]+[0-9]*)+$"), text)
    return F.when((size < 18 * 3600) & (size % 60 == 0), shown).otherwise(F.when(seconds.isNull(), region))


def _wall(y: Column, m: Column, d: Column, time_us: Column) -> Column:
    """Microseconds of a wall-clock reading counted as if it were UTC; null for an impossible date."""
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    most = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    fine = y.between(1601, 9999) & m.between(1, 12) & d.between(1, most)
    day = F.when(fine, F.unix_date(F.make_date(F.when(fine, y).otherwise(1970), F.when(fine, m).otherwise(1), F.when(fine, d).otherwise(1))))
    return day.cast("bigint") * F.lit(DAY_US) + time_us


def zoned_instant(wall_us: Column, zone: Column, received_us: Column) -> Column:
    """The instant of a wall-clock reading in a zone, by the policy of this module."""
    wall = F.timestamp_micros(wall_us)
    first = F.unix_micros(F.to_utc_timestamp(wall, zone))
    # The other reading of an overlap lies 30 to 120 minutes on; a skipped reading does not come back.
    steps = F.array(*(F.lit(s) for s in (0, HOUR_US // 2, HOUR_US, 2 * HOUR_US)))
    read = F.filter(F.transform(steps, lambda s: first + s), lambda c: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(c), zone)) == wall_us)
    fits = F.filter(read, lambda c: (received_us - c >= 0) & (received_us - c < HOUR_US))
    return F.when(F.size(read) == 1, read[0]).when(F.size(read) > 1, F.try_element_at(fits, F.lit(-1)))


def pinned(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are computed once per row.

    A one-element explode keeps the optimizer from copying the expressions into every later use,
    which for a chain of dependent columns would grow the plan exponentially.
    """
    row = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("__ts_pin")
    return df.select("*", row).select(*df.columns, *(F.col("__ts_pin").getField(n).alias(n) for n in columns))


def normalise(df: DataFrame, text: str, zone: Column, date_order: Column, received: Column, to: str = "ts_us") -> DataFrame:
    """df with the column `to`: microseconds since 1970 UTC of the text, or null where it names no one instant.

    zone is the default clock of the row ('+HH:MM' or a region name, null if unknown), date_order
    'mdy' or 'dmy' for slashed dates. Digits beyond microseconds are dropped.
    """
    upper = F.regexp_replace(F.upper(trimmed(F.col(text))), "−", "-")
    got = pinned(df, {"__ts_text": upper, "__ts_zone0": zone, "__ts_order": F.lower(trimmed(date_order)), "__ts_rec": F.unix_micros(received)})
    got = pinned(got, {"__ts_f": _fields(F.col("__ts_text"))})
    f = {n: F.nullif(F.col("__ts_f")[i], F.lit("")) for i, n in enumerate(FIELDS, 1)}
    number = {n: f[n].try_cast("int") for n in ("y", "m", "d", "a", "b", "h", "mi", "s")}
    month = F.coalesce(number["m"], _lookup(MONTHS, f["mon"]), F.when(F.col("__ts_order") == "mdy", number["a"]).when(F.col("__ts_order") == "dmy", number["b"]))
    day = F.coalesce(number["d"], F.when(F.col("__ts_order") == "mdy", number["b"]).when(F.col("__ts_order") == "dmy", number["a"]))
    hour = F.when(f["ap"].isNull(), number["h"]).when(number["h"].between(1, 12), number["h"] % 12 + F.when(f["ap"] == "PM", 12).otherwise(0))
    second = F.coalesce(number["s"], F.lit(0))
    fraction = F.coalesce(F.rpad(F.substring(f["f"], 1, 6), 6, "0").try_cast("bigint"), F.lit(0).cast("bigint"))
    clock = hour.cast("bigint") * F.lit(HOUR_US) + number["mi"].cast("bigint") * F.lit(60 * SECOND_US) + second.cast("bigint") * F.lit(SECOND_US) + fraction
    time_us = F.when(hour.between(0, 23) & number["mi"].between(0, 59) & second.between(0, 59), clock)
    named = F.create_map(*(F.lit(x) for kv in ZONE_MINUTES.items() for x in kv))
    digits = F.regexp_replace(f["z"], ":", "")
    minutes = (
        F.when(f["off"].isNotNull(), f["off"].try_cast("int"))
        .when(digits.rlike(r"^[+-]\d{4}$"), F.when(F.substring(digits, 1, 1) == "-", -1).otherwise(1) * (F.substring(digits, 2, 2).try_cast("int") * 60 + F.substring(digits, 4, 2).try_cast("int")))
        .otherwise(F.try_element_at(named, f["z"]))
    )
    got = pinned(got, {"__ts_m": month, "__ts_d": day, "__ts_t": time_us, "__ts_off": minutes, "__ts_has_zone": f["z"].isNotNull() | f["off"].isNotNull()})
    offset_us = F.col("__ts_off").cast("bigint") * F.lit(60 * SECOND_US)

    def instant(wall: Column) -> Column:
        return F.when(F.col("__ts_has_zone"), F.when(F.abs(F.col("__ts_off")) < 18 * 60, wall - offset_us)).when(F.col("__ts_zone0").isNotNull(), zoned_instant(wall, F.col("__ts_zone0"), F.col("__ts_rec")))

    # A missing year: the latest year in which the date exists and its earliest reading is not after receipt.
    day_number = F.floor((F.col("__ts_rec") + F.lit(DAY_US)) / F.lit(DAY_US)).cast("int")
    got = pinned(got, {"__ts_near": F.year(F.date_from_unix_date(day_number))})

    def earliest(wall: Column) -> Column:
        local = F.when(F.col("__ts_zone0").isNotNull(), F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), F.col("__ts_zone0"))))
        return F.when(F.col("__ts_has_zone"), wall - offset_us).otherwise(local)

    past = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda back: _wall(F.col("__ts_near") - back, F.col("__ts_m"), F.col("__ts_d"), F.col("__ts_t")))
    yearless = F.try_element_at(F.filter(past, lambda w: F.coalesce(earliest(w) <= F.col("__ts_rec"), F.lit(False))), F.lit(1))
    dated = _wall(number["y"], F.col("__ts_m"), F.col("__ts_d"), F.col("__ts_t"))
    got = pinned(got, {"__ts_wall": F.when(F.col("__ts_f")[0] == "syslog", yearless).otherwise(dated)})
    weekday = F.pmod(F.floor(F.col("__ts_wall") / F.lit(DAY_US)) + 3, F.lit(7)) + 1
    agrees = f["wd"].isNull() | F.coalesce(_lookup(WEEKDAYS, f["wd"]) == weekday, F.lit(False))
    found = F.coalesce(number_instant(F.col("__ts_text")), F.when(agrees, instant(F.col("__ts_wall"))))
    got = pinned(got, {"__ts_found": found})
    out = got.withColumn(to, F.when(F.col("__ts_rec").isNull() | (F.col("__ts_found") <= F.col("__ts_rec")), F.col("__ts_found")))
    return out.drop("__ts_text", "__ts_zone0", "__ts_order", "__ts_rec", "__ts_f", "__ts_m", "__ts_d", "__ts_t", "__ts_off", "__ts_has_zone", "__ts_near", "__ts_wall", "__ts_found")
