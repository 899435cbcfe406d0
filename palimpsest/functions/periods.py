"""Period labels, calendar ends, cutoffs and keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.schemas import FREQUENCY_ALIASES


def month_end(d: Column) -> Column:
    return F.last_day(d)


def quarter_end(d: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(d, "QUARTER"), 2))


def friday_week_end(d: Column) -> Column:
    """The Friday that ends d's week (Saturday to Friday)."""
    return F.next_day(F.date_sub(d, 1), "Fri")


def quarter_label(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


def quarter_of_label(label: Column) -> Column:
    """'2020Q3' -> the quarter's last day."""
    year, q = F.regexp_extract(label, r"^(\d{4})Q([1-4])$", 1), F.regexp_extract(label, r"^(\d{4})Q([1-4])$", 2)
    return F.when(q != "", F.last_day(F.make_date(F.try_to_number(year, F.lit("9999")).cast("int"), (F.try_to_number(q, F.lit("9")) * 3).cast("int"), F.lit(1))))


def vintage_cutoff(quarter: Column, label: Column) -> Column:
    """The last day of the month that lies ``label`` months after the quarter's end."""
    return F.last_day(F.add_months(quarter, label))


def vintage_label(label: Column) -> Column:
    """'+2' -> '2'."""
    return F.replace(F.trim(label), F.lit("+"), F.lit(""))


def frequency_code(raw: Column) -> Column:
    """Any spelling of a frequency -> its code; unknown ones -> M."""
    table = F.create_map(*(F.lit(x) for kv in FREQUENCY_ALIASES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.upper(F.trim(raw))), F.lit("M"))


def _int(label: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(label, pattern, group), F.lit("")).cast("int")


#: Pattern of a label, its frequency, and how its first day follows from the pattern's groups; the first that fits counts.
SCHOOL, DAY, QUARTER, HALF, WEEK = r"^(\d{4})[-–](\d{4})$", r"^(\d{4})-(\d{2})-(\d{2})$", r"^(\d{4})[- ]?[QK]([1-4])$", r"^(\d{4})-?[SP]([12])$", r"^(\d{4})-?W(\d{1,2})$"
MONTH_M, MONTH_DASH, MONTH_RUN, YEAR = r"^(\d{4})[- ]?M(\d{1,2})$", r"^(\d{4})-(\d{2})$", r"^(\d{4})(0[1-9]|1[0-2])$", r"^(\d{4})$"


def period_start(label: Column) -> Column:
    """The first day of a labelled period; null for a label of no known form or an impossible date.

    Forms: school year (1 September), day, quarter (Q or K), half-year (S or P), ISO week (its Monday), month, year.
    """
    x = F.upper(F.trim(label))
    one = F.lit(1)
    month = lambda p: F.when(_int(x, p, 2).between(1, 12), F.make_date(_int(x, p, 1), _int(x, p, 2), one))
    monday = F.date_add(F.next_day(F.date_sub(F.make_date(_int(x, WEEK, 1), one, F.lit(4)), 7), "Mon"), 7 * (_int(x, WEEK, 2) - 1))
    return (
        F.when(x.rlike(SCHOOL), F.make_date(_int(x, SCHOOL, 1), F.lit(9), one))
        .when(x.rlike(DAY), F.try_to_timestamp(x, F.lit("yyyy-MM-dd")).cast("date"))
        .when(x.rlike(QUARTER), F.make_date(_int(x, QUARTER, 1), 3 * _int(x, QUARTER, 2) - 2, one))
        .when(x.rlike(HALF), F.make_date(_int(x, HALF, 1), 6 * _int(x, HALF, 2) - 5, one))
        .when(x.rlike(WEEK) & _int(x, WEEK, 2).between(1, 53), monday)
        .when(x.rlike(MONTH_M), month(MONTH_M))
        .when(x.rlike(MONTH_DASH), month(MONTH_DASH))
        .when(x.rlike(MONTH_RUN), month(MONTH_RUN))
        .when(x.rlike(YEAR), F.make_date(_int(x, YEAR, 1), one, one))
    )


def period_frequency(label: Column) -> Column:
    """The frequency code of a labelled period; M for a label of no known form."""
    x = F.upper(F.trim(label))
    out = F.when(x.rlike(SCHOOL), "SY").when(x.rlike(DAY), "D").when(x.rlike(WEEK), "W").when(x.rlike(HALF), "S").when(x.rlike(QUARTER), "Q")
    return out.when(x.rlike(MONTH_M) | x.rlike(MONTH_DASH) | x.rlike(MONTH_RUN), "M").when(x.rlike(YEAR), "A").otherwise("M")


def flexible_date(text: Column, pattern: str = "dd.MM.yyyy") -> Column:
    """By the pattern, else a year, else the month that an ISO date begins with, else null."""
    x = F.trim(text)
    return F.coalesce(F.try_to_timestamp(x, F.lit(pattern)).cast("date"), F.when(x.rlike(YEAR), F.make_date(_int(x, YEAR, 1), F.lit(1), F.lit(1))), F.when(x.rlike(r"^\d{4}-\d{2}"), F.try_to_timestamp(F.concat(F.substring(x, 1, 7), F.lit("-01")), F.lit("yyyy-MM-dd")).cast("date")))


def dotted_key(code: Column, **parts: Column) -> Column:
    """code.k=v.k=v with null shown as None."""
    return F.concat_ws(".", code, *(F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit("None"))) for k, v in parts.items()))


def piped_key(code: Column, **parts: Column) -> Column:
    """code|k=v|k=v with the parts in the order of their names."""
    return F.concat_ws("|", code, *(F.concat(F.lit(f"{k}="), F.coalesce(parts[k].cast("string"), F.lit("None"))) for k in sorted(parts)))


def joined_key(*parts: Column) -> Column:
    """The parts joined by _, with runs of white space turned into _."""
    return F.regexp_replace(F.concat_ws("_", *parts), r"\s+", "_")


def normal_key(x: Column) -> Column:
    return F.lower(F.trim(x))


def file_token(x: Column) -> Column:
    """x with everything but letters, digits, dot and dash turned into _, without _ at the ends."""
    return F.regexp_replace(F.regexp_replace(x, r"[^A-Za-z0-9.\-]+", "_"), r"^_+|_+$", "")
