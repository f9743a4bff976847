"""Scalar functions on text: decoding, names, sizes and epochs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def percent_decode(text: Column) -> Column:
    """URL-decode once; stray percent signs stay, plus signs too."""
    safe = F.regexp_replace(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.try_url_decode(safe)


def web_decode(text: Column) -> Column:
    """An attacker's string made plain: ``\\xNN`` escapes, plus signs as spaces, two rounds of URL decoding, lower case."""
    escapes = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\x([0-9a-fA-F]{2})", "%$1")
    return F.lower(percent_decode(percent_decode(F.replace(escapes, F.lit("+"), F.lit(" ")))))


def _clf_shape(raw: Column) -> Column:
    return raw.rlike(r"^\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}")


def _month(name: Column) -> Column:
    """Two digits of a month's name; nought for what is none."""
    at = F.instr(F.lit("".join(MONTHS)), name)
    return F.when((at % 3 == 1) & (F.length(name) == 3), F.lpad(((at + 2) / 3).cast("int").cast("string"), 2, "0")).otherwise("00")


def clf_time(raw: Column) -> Column:
    """``19/May/2026:09:11:17 +0000`` as ``2026-05-19 09:11:17 +0000``; other text as it is. Fields stand at fixed places, so
    they are cut and not matched one by one; what follows the zone is left out."""
    zone = F.regexp_extract(raw.substr(F.lit(21), F.lit(16)), r"^\s*([+-]\d{4})", 1)
    plain = F.when(raw.substr(21, 2).isin(" +", " -") & (F.length(raw) == 26), raw.substr(22, 5)).otherwise(zone)
    text = F.concat(raw.substr(8, 4), F.lit("-"), _month(raw.substr(4, 3)), F.lit("-"), raw.substr(1, 2), F.lit(" "), raw.substr(13, 8), F.lit(" "), plain)
    return F.when(_clf_shape(raw), F.rtrim(text)).otherwise(raw)


def iso_instant(time: Column) -> Column:
    """The timestamp of what ``clf_time`` gives; null where that has no zone or isn't a time."""
    return F.when(F.length(time) == 25, F.concat(time.substr(1, 19), time.substr(21, 3), F.lit(":"), time.substr(24, 2)).try_cast("timestamp"))


def file_ext(path: Column) -> Column:
    """Lower-case extension of a request path's last segment, else empty."""
    return F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([A-Za-z0-9]{1,10})$", 1))


def hex_or_same(value: Column) -> Column:
    """Text that hexadecimal digits of even number spell, else the value itself."""
    is_hex = value.rlike(r"^(?:[0-9A-Fa-f]{2})+$")
    return F.when(is_hex, F.decode(F.try_to_binary(F.when(is_hex, value), F.lit("hex")), "utf-8")).otherwise(value)


def epoch_time(digits: Column) -> Column:
    """Timestamp of an epoch whose unit its number of digits tells: ns from 18, us from 15, ms from 12, else seconds."""
    n = F.length(digits)
    value = digits.try_cast("decimal(20,0)")
    micros = F.when(n >= 18, value / 1000).when(n >= 15, value).when(n >= 12, value * 1000).otherwise(value * 1000000)
    return F.timestamp_micros(F.floor(micros).cast("long"))


def as_utc(text: Column) -> Column:
    """A log's time stamp as an instant: an offset is applied, a bare date and time counts as UTC, and what has no year, or
    is no time, is null."""
    t = F.trim(text)
    at = lambda i: F.regexp_extract(t, r"^(\d{4}-\d\d-\d\d)[ T](\d\d:\d\d:\d\d)(?:\.\d+)?\s*(?:([+-])(\d\d):?(\d\d)|Z)?", i)
    local = F.try_to_timestamp(F.concat_ws(" ", at(1), at(2)), F.lit("yyyy-MM-dd HH:mm:ss"))
    away = (F.coalesce(at(4).try_cast("int"), F.lit(0)) * 60 + F.coalesce(at(5).try_cast("int"), F.lit(0))) * F.when(at(3) == "-", -1).otherwise(1)
    return F.timestamp_micros(F.unix_micros(local) - away.cast("long") * 60000000)


def filetime(value: Column) -> Column:
    """Timestamp of 100 ns steps since 1601."""
    return F.timestamp_micros(F.floor(value.cast("long") / 10).cast("long") - F.lit(11644473600000000))


def webkit_time(micros: Column) -> Column:
    """Timestamp of microseconds since 1601."""
    return F.timestamp_micros(micros.cast("long") - F.lit(11644473600000000))


def cim_time(text: Column) -> Column:
    """UTC timestamp of ``yyyymmddHHMMSS.ffffff+MMM``, the offset being minutes."""
    local = F.try_to_timestamp(F.substring(text, 1, 14), F.lit("yyyyMMddHHmmss"))
    offset = F.coalesce(F.regexp_extract(text, r"([+-]\d{3})$", 1).try_cast("int"), F.lit(0))
    return F.timestamp_micros(F.unix_micros(local) - offset.cast("long") * 60000000)


def human_size(n: Column, units: tuple[str, ...] = ("KB", "MB", "GB", "TB")) -> Column:
    """Bytes as ``1.5 MB``; what is too large for ``units`` has the last of them."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate(units, start=1):
        out = F.when(n >= 1024**power, F.concat(F.format_string("%.1f", n / float(1024**power)), F.lit(f" {unit}"))).otherwise(out)
    return out


def url_host(url: Column) -> Column:
    """Lower-case host of a URL, without user and port."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))


def basename(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/\\]*)$", 1)


def short_machine(name: Column) -> Column:
    """First label of a host name, upper-cased."""
    return F.upper(F.substring_index(name, ".", 1))
