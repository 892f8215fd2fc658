"""Date normalisation: ISO-8601 first, RFC-822 next, else null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newslake.functions.text import strip

# Zone names of RFC 822.
ZONE_OFFSETS = {
    "UT": "+00:00",
    "UTC": "+00:00",
    "GMT": "+00:00",
    "Z": "+00:00",
    "EST": "-05:00",
    "EDT": "-04:00",
    "CST": "-06:00",
    "CDT": "-05:00",
    "MST": "-07:00",
    "MDT": "-06:00",
    "PST": "-08:00",
    "PDT": "-07:00",
}
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"

_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?([Zz]|[+-]\d{2}:?\d{2}(:\d{2})?)?)?$"
_RFC = (
    r"^(?:(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+|[A-Za-z]+,\s*)?(\d{1,2})[\s-]+([A-Za-z]{3})[A-Za-z]*[\s-]+(\d{4}|\d{2})\s+"
    r"(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\s+([+-]\d{4}|[A-Za-z]{1,4}))?(?:\s*\(.*\))?$"
)


def parse_iso(value: Column) -> Column:
    iso = F.when(value.rlike(_ISO), value)
    iso = F.regexp_replace(iso, r"([+-]\d{2})(\d{2})$", "$1:$2")
    # An hour without minutes is legal ISO-8601, but not for the cast.
    iso = F.regexp_replace(iso, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2})($|[Zz+-])", "$1:00$2")
    return F.replace(iso, F.lit(","), F.lit(".")).try_cast("timestamp")


def parse_rfc822(value: Column) -> Column:
    """Built from its fields, so that no locale or pattern letter of the parser matters."""
    part = [F.regexp_extract(value, _RFC, i) for i in range(8)]
    month = F.floor((F.instr(F.lit(MONTHS), F.lower(part[2])) + 2) / 3).cast("int")
    aligned = (F.instr(F.lit(MONTHS), F.lower(part[2])) % 3) == 1
    short = part[3].try_cast("int")
    year = F.when(F.length(part[3]) == 4, short).otherwise(
        F.when(short < 69, short + 2000).otherwise(short + 1900)
    )
    zone = F.upper(part[7])
    names = F.create_map(*[F.lit(x) for pair in ZONE_OFFSETS.items() for x in pair])
    offset = F.when(
        zone.rlike(r"^[+-]\d{4}$"), F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2))
    ).otherwise(F.coalesce(F.try_element_at(names, zone), F.lit("+00:00")))
    text = F.concat(
        F.lpad(year.cast("string"), 4, "0"), F.lit("-"),
        F.lpad(month.cast("string"), 2, "0"), F.lit("-"),
        F.lpad(part[1], 2, "0"), F.lit(" "),
        F.lpad(part[4], 2, "0"), F.lit(":"), part[5], F.lit(":"),
        F.when(part[6] == "", F.lit("00")).otherwise(part[6]), offset,
    )
    return F.when(value.rlike(_RFC) & aligned, text).try_cast("timestamp")


def normalise_date(value: Column) -> Column:
    """Timestamp of a feed or release date; null, empty and unreadable values give null."""
    clean = strip(value)
    return F.coalesce(parse_iso(clean), parse_rfc822(clean))


def iso_or_empty(date: Column) -> Column:
    """Exported form of a date: ISO text, the empty string when absent."""
    return F.coalesce(F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss+00:00"), F.lit(""))
