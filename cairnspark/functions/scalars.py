"""Scalar column expressions for points, times and requests."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371007.2
WHITE = " \t\n\r\x0b\x0c"
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def micro(v: Column) -> Column:
    """Whole millionths, halves away from zero; null if not finite. Zero has no sign."""
    return F.round(v * 1e6).try_cast("bigint")


def trimmed(s: Column) -> Column:
    return F.btrim(s, F.lit(WHITE))


def ascii_lower(s: Column) -> Column:
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def escape_xml(s: Column) -> Column:
    return F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def query_escape(s: Column) -> Column:
    """Form encoding in which ~ stays and * is encoded."""
    return F.replace(F.replace(F.url_encode(s), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def utc_time(s: Column) -> Column:
    """RFC 3339 text in UTC without fraction; other text as it is."""
    return F.when(s.rlike(RFC3339), F.coalesce(F.date_format(F.try_to_timestamp(s), "yyyy-MM-dd'T'HH:mm:ss'Z'"), s)).otherwise(s)


def now_text(now: Column) -> Column:
    """A timestamp as RFC 3339 text in UTC; the clock is given by the caller."""
    return F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def clock_time(ts: Column) -> Column:
    return F.date_format(ts, "h:mm a")


def short_date(ts: Column) -> Column:
    return F.date_format(ts, "d, MMM")


def fixed(v: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", v)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a sphere."""
    rad = math.pi / 180.0
    a = F.pow(F.sin((lat2 - lat1) * rad / 2), 2) + F.cos(lat1 * rad) * F.cos(lat2 * rad) * F.pow(F.sin((lon2 - lon1) * rad / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def clipped(s: Column, n: int, keep: int | None = None) -> Column:
    """Text longer than n is cut to keep characters and an ellipsis."""
    return F.when(F.length(s) > n, F.concat(F.left(s, F.lit(n if keep is None else keep)), F.lit("…"))).otherwise(s)


def float_or_zero(s: Column) -> Column:
    return F.coalesce(s.try_cast("double"), F.lit(0.0))


def pinched(zoom: Column, scale: Column, low: float = 1.0, high: float = 18.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), zoom + F.log2(scale)))


def back_off(attempt: Column) -> Column:
    """Seconds to wait before a retry."""
    return F.when(attempt <= 5, 2 * attempt).otherwise(30)


def tile_path(path: Column) -> Column:
    """z, x, y of a tile's path, or null."""
    part = lambda k: F.regexp_extract(path, r"^/api/tiles/(\d+)/(\d+)/(\d+)\.png$", k).try_cast("int")
    z, x, y = part(1), part(2), part(3)
    return F.when(z.isNotNull() & x.isNotNull() & y.isNotNull(), F.struct(z.alias("z"), x.alias("x"), y.alias("y")))


def tile_url(template: str, z: Column, x: Column, y: Column) -> Column:
    if template.count("%d") != 3:
        raise ValueError("a tile template has exactly three %d")
    return F.format_string(template, z, x, y)


def directory_path(url: Column) -> Column:
    """Without file:// and without one slash at the end."""
    bare = F.regexp_replace(url, r"^file://", "")
    return F.when(bare == "/", bare).otherwise(F.regexp_replace(bare, r"/$", ""))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def server_url(s: Column) -> Column:
    return F.rtrim(s, F.lit("/"))


#: The units of a duration, in seconds.
UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def duration(text: Column) -> Column:
    """Seconds of a text such as 1h30m or -1.5s, or null; 0 needs no unit."""
    part = r"(\d+\.?\d*|\.\d+)(ns|us|µs|ms|s|m|h)"
    numbers, units = (F.regexp_extract_all(text, F.lit(part), F.lit(k)) for k in (1, 2))
    scale = F.create_map(*(F.lit(v) for row in UNITS.items() for v in row))
    total = F.aggregate(F.zip_with(numbers, units, lambda n, u: n.cast("double") * F.element_at(scale, u)), F.lit(0.0), lambda a, x: a + x)
    return F.when(text.rlike(r"^[+-]?0$"), 0.0).when(text.rlike(f"^[+-]?({part})+$"), F.when(text.startswith("-"), -total).otherwise(total))


def setting(text: Column, default: float, least: float | None = None, above: float | None = None) -> Column:
    """The duration that a setting gives; the default for one that is not read or out of bounds."""
    seconds = duration(text)
    good = seconds.isNotNull()
    good = good if least is None else good & (seconds >= least)
    good = good if above is None else good & (seconds > above)
    return F.when(good, seconds).otherwise(default)


def whole_setting(text: Column, default: int, least: int) -> Column:
    number = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("long"))
    return F.when(number >= least, number).otherwise(default)


def timestamp_or_null(text: Column) -> Column:
    return F.try_to_timestamp(text)
