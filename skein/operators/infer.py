"""What a record's address and dates say where a field is missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import compare_key, first_set, squeeze, words

# Forms of dates, tried in this order.
SEED_DATES = (("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "d/M/yyyy"), ("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "yyyy-M-d"), ("^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$", "yyyy/M/d"), ("^[0-9]{8}$", "yyyyMMdd"))
#: A mail date: its day, month, year, time, and offset from UTC.
MAIL_DATE = r"^(?:[A-Za-z]{3},\s*)?([0-9]{1,2})\s+([A-Za-z]{3})\s+([0-9]{4})\s+([0-9]{2}:[0-9]{2}(?::[0-9]{2})?)\s*([+-][0-9]{4}|GMT|UTC|Z)?$"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
TITLE_CHARS = 180


def title_from_url(url: Column) -> Column:
    """The last segment of the path with spaces for hyphens and underscores; the address itself without a path. Null counts as empty."""
    url = F.coalesce(url, F.lit(""))
    path = F.btrim(F.regexp_extract(url, PATH, 1), F.lit("/"))
    slug = squeeze(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"[-_]+", " "))
    return first_set(F.substring(slug, 1, TITLE_CHARS), url)


def medium(url: Column, *names: Column) -> Column:
    """The first name that is given, else the host without ``www.`` anywhere."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)
    return first_set(*names, F.replace(host, F.lit("www."), F.lit("")))


def mail_time(text: Column) -> Column:
    """A date as mail and feeds write it, in UTC; null if it is none."""
    clean = squeeze(text)
    part = [F.regexp_extract(clean, MAIL_DATE, i) for i in range(1, 6)]
    time = F.when(F.length(part[3]) == 5, F.concat(part[3], F.lit(":00"))).otherwise(part[3])
    local = F.try_to_timestamp(F.concat_ws(" ", F.lpad(part[0], 2, "0"), F.initcap(part[1]), part[2], time), F.lit("dd MMM yyyy HH:mm:ss"))
    offset = F.when(part[4].rlike("^[+-]"), F.concat(F.substring(part[4], 1, 1), F.lit("1")).cast("int") * (F.substring(part[4], 2, 2).cast("int") * 60 + F.substring(part[4], 4, 2).cast("int"))).otherwise(0)
    return F.when(clean.rlike(MAIL_DATE), F.timestamp_seconds(F.unix_timestamp(local) - offset * 60))


def year(dates: Sequence[Column], otherwise: Column) -> Column:
    """The year of the first date that is given: its first four digits, else as a mail date; else ``otherwise``."""
    given = first_set(*dates)
    return F.when(given.rlike("^[0-9]{4}"), F.substring(given, 1, 4).cast("int")).otherwise(F.coalesce(F.year(mail_time(given)), otherwise))


def seed_date(text: Column) -> Column:
    """A date in one of the forms of seed lists, else a mail date; null if it is none."""
    clean = squeeze(text)
    out = F.to_date(mail_time(clean))
    for form, pattern in reversed(SEED_DATES):
        out = F.when(clean.rlike(form), F.to_date(F.try_to_timestamp(clean, F.lit(pattern)))).otherwise(out)
    return out


def in_period(time: Column, start: Column, end: Column) -> Column:
    """From the start of the first day to the end of the last; a missing time isn't in it."""
    return F.coalesce((time >= start) & (time < F.date_add(F.to_date(end), 1)), F.lit(False))


def allowed_exclusions(terms: Column, allowed: Sequence[str]) -> Column:
    """Those of the terms, in their order, whose folded form is one of ``allowed``: the only ones that exclude scholarly texts."""
    return F.filter(terms, lambda t: F.array_contains(F.transform(words(allowed), compare_key), compare_key(t)))
