"""Frequencies, countries, dimensions, seasonality and targets told from metadata; predicates formed from options."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Frequency by parts of an attribute's name (first match wins) and by its ids. (fixed values)
FREQUENCY_WORDS = [
    ("SY", ["mokymo met", "mokslo met", "school year"], ["4", "sy"]),
    ("A", ["met"], ["3", "a", "y", "year"]),
    ("Q", ["ketv"], ["1", "q", "quarter"]),
    ("S", ["pusm", "pusmėt", "semi", "half", "semester"], ["5", "s", "h", "p", "p1", "p2", "half-year", "halfyear", "semi-annual", "semiannual", "semester"]),
    ("M", ["mėn", "men"], ["2", "m", "month"]),
    ("W", ["savait"], ["w", "week"]),
    ("D", ["dien"], ["d", "day"]),
]
#: Names of dimensions, best first. (fixed values)
TIME_NAMES = ["TIME_PERIOD", "TIME", "PERIOD", "LAIKOTARPIS"]
GEO_NAMES = ["REF_AREA", "GEO", "REGION", "SAVIVALDYBE", "savivaldybe", "savivaldybesRegdb"]
UNIT_NAMES = ["UNIT_MEASURE", "UNIT", "MATVNT"]
#: Words of unadjusted and of adjusted data; the former win. (fixed values)
UNADJUSTED = ["not seasonally adjusted", "unadjusted", " nsa", "_nsa", " -nsa", "s_adj=nsa"]
ADJUSTED = ["seasonal adjustment", "seasonally adjusted", " sa", "_sa", " -sa", "s_adj=sa", "s_adj=sca"]


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def attribute_frequency(name: Column, id: Column, otherwise: Column) -> Column:  # noqa: A002
    """Frequency from a time-format attribute's name or id; where neither tells, another column (say, from the label)."""
    name, id = F.coalesce(F.lower(F.trim(name)), F.lit("")), F.coalesce(F.lower(F.trim(id)), F.lit(""))  # noqa: A001
    out = otherwise
    for frequency, words, ids in reversed(FREQUENCY_WORDS):
        out = F.when(_any(name, words) | id.isin(ids), F.lit(frequency)).otherwise(out)
    return out


def guessed_country(*geo: Column) -> Column:
    return F.coalesce(*(g.cast("string") for g in geo), F.lit("EU"))


def guessed_frequency(given: Column, label: Column) -> Column:
    """The given frequency, else what a period's label looks like: Q, then M or a dash, else annual."""
    return F.coalesce(given.cast("string"), F.when(label.contains("Q"), "Q").when(label.contains("M") | label.contains("-"), "M").otherwise("A"))


def guessed_dimension(columns: list[str], names: list[str]) -> str | None:
    return next((x for x in names if x in columns), None)


def time_dimension(columns: list[str], declared: str | None = None) -> str:
    """The declared time dimension if the table has it, else the first known name; an error without either."""
    found = declared if declared in columns else guessed_dimension(columns, TIME_NAMES)
    if found is None:
        raise ValueError("no time dimension")
    return found


def seasonality(text: Column) -> Column:
    """'nsa', 'sa' or 'unknown' from metadata."""
    text = F.lower(text)
    return F.when(_any(text, UNADJUSTED), "nsa").when(_any(text, ADJUSTED), "sa").otherwise("unknown")


def seasonal(kind: Column, autocorrelation: Column, least: float = 0.2) -> Column:
    """Whether a series is seasonal: by its metadata, and where these do not tell by its autocorrelation at a year's lag."""
    return F.when(kind == "nsa", True).when(kind == "sa", False).otherwise(F.coalesce(autocorrelation > least, F.lit(False)))


def conjunction(options: dict) -> Column:
    """One predicate from options: column to value, list of values, or (operator, value); None leaves a column out."""
    out = F.lit(True)
    for column, want in options.items():
        c = F.col(column)
        if want is None:
            continue
        if isinstance(want, tuple):
            op, value = want
            out &= {"=": c == value, ">=": c >= value, "<=": c <= value, "like": c.ilike(str(value)), "between": None}[op] if op != "between" else c.between(*value)
        else:
            out &= c.isin(want) if isinstance(want, list) else c == want
    return out


def first_match(rows: DataFrame, cascade: list[Column], key: str, within: list[str] = ()) -> DataFrame:
    """The row that fits the earliest predicate of the cascade (then the smallest key), one for each group; rows that fit none are out."""
    level = F.lit(None).cast("int")
    for k, c in reversed(list(enumerate(cascade))):
        level = F.when(c, F.lit(k)).otherwise(level)
    d = rows.withColumn("level", level).where("level is not null")
    whole = F.struct("level", key, F.struct(*(c for c in rows.columns)).alias("row"))
    return (d.groupBy(*within) if within else d.groupBy()).agg(F.min(whole).alias("m")).where("m is not null").select("m.level", "m.row.*")


def discovered(catalogue: DataFrame, geo: str, frequencies: list[str], most: int | None = None, code: str = "code") -> DataFrame:
    """The datasets whose geo values have geo and whose freq values meet the wanted ones; freqs: those that they share."""
    want = F.array(*map(F.lit, frequencies))
    d = catalogue.where(F.array_contains("geos", geo) & F.arrays_overlap("freqs", want))
    d = d.withColumn("freqs", F.array_sort(F.array_intersect("freqs", want)))
    return d.orderBy(code).limit(most) if most is not None else d


def batched(words: DataFrame, size: int = 5, within: str = "group", word: str = "word") -> DataFrame:
    """words with the number of their batch of at most ``size``, counted in each group."""
    return words.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(within).orderBy(word)) - 1) / size).cast("int"))
