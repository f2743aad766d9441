"""Column helpers for log lines, server names and run names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n"
# The patterns the log formats are recognised by.
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)"
IPV4 = rf"(?:{OCTET}\.){{3}}{OCTET}"
RUN_DATE = "[0-1][0-9][0-3][0-9]"
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def tokens(text: Column) -> Column:
    """Words of a line, split at runs of blanks."""
    return F.split(strip(text), r"\s+")


def word(text: Column, n: int) -> Column:
    """The n-th word (0-based), NULL beyond the end."""
    return F.get(tokens(text), F.lit(n))


def field(text: Column, separator: str, n: int) -> Column:
    """The n-th field (0-based) without outer blanks, NULL beyond the end."""
    return strip(F.get(F.split(text, separator), F.lit(n)))


def before(text: Column, unit: str) -> Column:
    """The text in front of a unit, without outer blanks."""
    return strip(F.substring_index(text, unit, 1))


def number(text: Column, kind: str = "double") -> Column:
    return strip(text).try_cast(kind)


def numbers(words: Column, kind: str = "double") -> Column:
    return F.transform(words, lambda w: w.try_cast(kind))


def ip_in(text: Column) -> Column:
    """First IPv4 address in the text, NULL without one."""
    return F.nullif(F.regexp_extract(text, f"({IPV4})", 1), F.lit(""))


def ip_valid(text: Column) -> Column:
    """Four dot-separated parts, digits only, each at most 255."""
    parts = F.split(text, r"\.")
    return (F.size(parts) == 4) & F.forall(
        parts, lambda p: p.rlike("^[0-9]+$") & F.coalesce(p.try_cast("int") <= 255, F.lit(False))
    )


def host_to_ip(host: Column) -> Column:
    """``tdw-10-0-0-3`` -> ``10.0.0.3``."""
    return F.replace(F.translate(host, "-", "."), F.lit("tdw."), F.lit(""))


def host_of(path: Column) -> Column:
    """Server folder of a file path (``host=`` in front is allowed), NULL without one."""
    return F.nullif(F.regexp_extract(path, r"/(?:host=)?(tdw[^/]*)/", 1), F.lit(""))


def run_of(path: Column) -> Column:
    """Run folder of a file path: named ``run=``, or above the server folder, or the file's own."""
    part = lambda pattern: F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))
    return F.coalesce(part("/run=([^/]+)/"), part("/([^/]+)/(?:host=)?tdw[^/]*/"), part("/([^/]+)/[^/]+$"))


def run_name_valid(run: Column) -> Column:
    return run.rlike(RUN_DATE)


def run_date(run: Column) -> Column:
    """``0711-24H-td3`` -> ``07/11``."""
    return F.concat_ws("/", F.substring(run, 1, 2), F.substring(run, 3, 2))


def run_hours(run: Column) -> Column:
    return F.get(F.split(run, "-"), F.lit(1))


def run_tag(run: Column) -> Column:
    """Everything behind the hours joined by ``-``; ``POC`` when there is nothing."""
    parts = F.split(run, "-")
    return F.when(F.size(parts) == 2, F.lit("POC")).otherwise(
        F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), "-")
    )


def job_key(attempt: Column) -> Column:
    """The job an attempt id belongs to: its first four ``_`` parts."""
    return F.substring_index(attempt, "_", 4)


def short_ip(ip: Column) -> Column:
    return F.substring_index(ip, ".", -2)


def header_time(words: Column) -> Column:
    """Timestamp from the words of a block header; the zone is ignored (naive local time)."""
    part = lambda n: F.get(words, F.lit(n))
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), part(2))
    date = F.concat_ws("-", part(6), month, part(3))
    return F.concat_ws(" ", date, part(4)).try_cast("timestamp_ntz")


def header_date(words: Column) -> Column:
    """The six date words of a block header, as text."""
    return F.array_join(F.slice(words, 2, 6), " ")


def header_hour(words: Column) -> Column:
    return F.substring_index(F.get(words, F.lit(4)), ":", 1).try_cast("int")


def day_of(date: Column) -> Column:
    """``Tue Jul 11 00:00:01 CST 2017`` -> ``Jul-11``."""
    return F.array_join(F.slice(tokens(date), 2, 2), "-")


def weekday_of(date: Column) -> Column:
    return word(date, 0)


def year_of(date: Column) -> Column:
    return word(date, 5)


def minute_of(date: Column) -> Column:
    """``HH:MM`` of the date text."""
    return F.substring_index(word(date, 3), ":", 2)
