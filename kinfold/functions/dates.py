"""Uncertain dates: struct lo, hi (integers yyyymmdd, null for an open end), precision, status, original."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim

MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
LEAST, MOST = -(1 << 31), (1 << 31) - 1


def date_range(lo: Column, hi: Column, precision: Column | str, status: Column | str, original: Column | None = None) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), as_column(precision).alias("precision"), as_column(status).alias("status"), (F.lit(None).cast("string") if original is None else original).alias("original"))


def bind(value: Column, body) -> Column:
    """body(value) with value worked out once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def days_in(year: Column, month: Column) -> Column:
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def parse_date(c: Column) -> Column:
    """d.m.yyyy and yyyy-mm-dd (exact), m.yyyy (month), yyyy (year); empty is unknown, all else invalid. Null is empty."""
    german, iso, month, year = r"^(\d{1,2})\.\s*(\d{1,2})\.\s*(\d{4})\z", r"^(\d{4})-(\d{2})-(\d{2})\z", r"^(\d{1,2})\.(\d{4})\z", r"^(\d{4})\z"

    def parts(s: Column) -> Column:
        number = lambda pattern, k: F.regexp_extract(s, pattern, k).try_cast("int")
        # Only the patterns that the separators leave are tried.
        by = lambda dotted, dashed=None, other=None: F.when(s.contains("."), dotted).when(s.contains("-"), dashed).otherwise(other)
        return F.struct(
            s.alias("s"), by(F.coalesce(number(german, 3), number(month, 2)), number(iso, 1), number(year, 1)).alias("y"),
            by(F.coalesce(number(german, 2), number(month, 1)), number(iso, 2)).alias("m"), by(number(german, 1), number(iso, 3)).alias("d"),
        )

    def build(p: Column) -> Column:
        s, y, m, d = (p[k] for k in ("s", "y", "m", "d"))
        ok = F.coalesce((y >= 1) & (m.isNull() | m.between(1, 12)) & (d.isNull() | d.between(1, days_in(y, m))), F.lit(False))
        lo = y * 10000 + F.coalesce(m, F.lit(1)) * 100 + F.coalesce(d, F.lit(1))
        hi = y * 10000 + F.coalesce(m, F.lit(12)) * 100 + F.coalesce(d, days_in(y, F.coalesce(m, F.lit(12))))
        none = F.lit(None).cast("int")
        precision = F.when(d.isNotNull(), "exact").when(m.isNotNull(), "month").otherwise("year")
        return F.when(s == "", date_range(none, none, "open", "unknown")).when(ok, date_range(lo, hi, precision, "known", s)).otherwise(date_range(none, none, "open", "invalid", s))

    return bind(bind(trim(F.coalesce(c, F.lit(""))), parts), build)


def known(r: Column) -> Column:
    return F.coalesce(r["status"] == "known", F.lit(False))


def low(r: Column) -> Column:
    return F.coalesce(r["lo"], F.lit(LEAST))


def high(r: Column) -> Column:
    return F.coalesce(r["hi"], F.lit(MOST))


def is_exact(r: Column) -> Column:
    return F.coalesce(known(r) & (r["precision"] == "exact") & (r["lo"] == r["hi"]), F.lit(False))


def overlaps(a: Column, b: Column) -> Column:
    return known(a) & known(b) & (low(a) <= high(b)) & (low(b) <= high(a))


def contains(r: Column, key: Column) -> Column:
    return F.coalesce(known(r) & key.between(low(r), high(r)), F.lit(False))


def first_year(r: Column) -> Column:
    return F.when(known(r), F.floor(r["lo"] / 10000).cast("int"))


def last_year(r: Column) -> Column:
    return F.when(known(r), F.floor(r["hi"] / 10000).cast("int"))


def iso(key: Column) -> Column:
    return F.concat(F.lpad(F.floor(key / 10000).cast("string"), 4, "0"), F.lit("-"), F.lpad((F.floor(key / 100) % 100).cast("string"), 2, "0"), F.lit("-"), F.lpad((key % 100).cast("string"), 2, "0"))


def shown(r: Column) -> Column:
    """A range as a conflict shows it."""
    a, b = first_year(r), last_year(r)
    return (
        F.when(r["status"] == "invalid", "(uninterpretable)").when(is_exact(r), iso(r["lo"]))
        .when(r["lo"].isNull() | r["hi"].isNull(), F.coalesce(r["original"], F.lit("")))
        .when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a.cast("string"), b.cast("string")))
    )


def iso_to_gedcom(c: Column) -> Column:
    """D MON YYYY of an exact ISO date, else null."""

    def build(r: Column) -> Column:
        month = F.element_at(F.array(*(F.lit(m) for m in MONTHS)), (F.floor(r["lo"] / 100) % 100).cast("int"))
        return F.when(r["status"] == "known", F.concat_ws(" ", (r["lo"] % 100).cast("string"), month, F.floor(r["lo"] / 10000).cast("string")))

    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}\z"), bind(parse_date(c), build))


def iso_to_german(c: Column) -> Column:
    return F.regexp_replace(c, r"^(\d{4})-(\d{2})-(\d{2})\z", "$3.$2.$1")
