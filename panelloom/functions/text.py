"""Names, number tokens, classifiers and codes, as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that tell a municipality's type, in the order in which they are taken out.
TYPE_PHRASES = (
    "закрытое административно-территориальное образование",
    "муниципальное образование",
    "муниципальный район",
    "муниципальный округ",
    "городской округ",
    "городское поселение",
    "внутригородская территория",
    "внутригородское муниципальное образование",
)
TYPE_WORDS = ("город", "район", "г", "зато")
STEM_PHRASES = ("внутригородская территория города федерального значения", "муниципальный район", "муниципальный округ", "городской округ", "город", "поселок")

# Tokens that stand for no number.
SUPPRESSED = ("...", "…", "х", "x", "X", "Х")
UNKNOWN = ("SD", "UD")
NOT_REPORTED = ("ND", "CD", "NR")
DASHES = ("-", "–", "—")

# Cyrillic letters that look like these Latin ones.
LOOKALIKE_CYRILLIC, LOOKALIKE_LATIN = "АВЕНСО", "ABEHCO"

# How captions of indicators begin, and what they must hold.
WAGE = "среднемесячная заработная плата работников организаций"
HEADCOUNT = "среднесписочная численность работников организаций"
NO_SMALL = "без субъектов малого"
EFFICIENCY_WAGE = "среднемесячная номинальная начисленная заработная плата работников крупных"
POPULATION = "оценка численности населения на 1 января текущего года"
POPULATION_AGE_SEX = "численность всего населения по полу и возрасту на 1 января текущего года"

#: White space, of which runs count as one blank.
SPACE = r"[\s\x{00A0}]+"


def clean(text: Column) -> Column:
    """White space evened out: runs are one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def name_key(text: Column) -> Column:
    """A name without its type, for joins: lower case, letters and digits alone."""
    out = F.translate(F.lower(clean(text)), "ё", "е")
    out = F.regexp_replace(out, r"\((?:до|с) \d[^)]*\)", " ")
    out = F.replace(out, F.lit("город-герой"), F.lit("город"))
    for phrase in TYPE_PHRASES:
        out = F.replace(out, F.lit(phrase), F.lit(" "))
    out = F.regexp_replace(out, rf"(?<![0-9a-zа-я_])(?:{'|'.join(TYPE_WORDS)})(?![0-9a-zа-я_])", " ")
    return F.regexp_replace(out, "[^а-яa-z0-9]", "")


def stem(text: Column) -> Column:
    """A name in lower case without the words of a municipality's type."""
    out = F.translate(F.lower(text), "ё", "е")
    return clean(F.regexp_replace(out, "|".join(STEM_PHRASES), " "))


def normal_name(text: Column) -> Column:
    """A name in compatibility form and lower case, white space evened out; a null stays null."""

    @F.pandas_udf("string")
    def nfkc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda s: s if s is None else " ".join(unicodedata.normalize("NFKC", s).split()).casefold())

    return nfkc(text)


def number_status(text: Column) -> Column:
    """A struct of ``value`` and ``status`` of a number token with blanks and a decimal comma."""
    token = clean(F.coalesce(text, F.lit("")))
    plain = F.translate(token, " ,", "\0.").cast("string")
    plain = F.replace(plain, F.lit("\0"), F.lit(""))
    number = F.when(plain.rlike(r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)$"), plain.try_cast("double"))
    status = (
        F.when(token == "", "missing")
        .when(token.isin(*SUPPRESSED), "suppressed")
        .when(token.isin(*UNKNOWN), "suppressed_or_unknown")
        .when(token.isin(*NOT_REPORTED), "not_reported")
        .when(token.isin(*DASHES), "not_applicable_or_absent")
        .when(number.isNull() | (F.abs(number) >= 1e20), "unparsed")
        .otherwise("observed")
    )
    return F.struct(F.when(status == "observed", number).alias("value"), status.alias("status"))


def wage_status(text: Column) -> Column:
    """A struct of ``value``, the logarithm of a positive wage, and ``status``."""
    token = F.trim(F.coalesce(text, F.lit("")))
    low = F.lower(token)
    plain = F.replace(F.regexp_replace(token, SPACE, ""), F.lit(","), F.lit("."))
    number = plain.try_cast("double")
    status = (
        F.when(low.isin("", "...", "…", "x", "х", "na", "n/a", "null", "none"), "missing_or_suppressed")
        .when(F.upper(token).isin(*UNKNOWN, *NOT_REPORTED), F.concat(F.lit("source_marker_"), F.upper(token)))
        .when(token.isin(*DASHES), "not_applicable_or_absent")
        .when(number.isNull(), "invalid_numeric")
        .when(F.isnan(number) | (F.abs(number) == float("inf")), "nonfinite")
        .when(number == 0, "zero")
        .when(number < 0, "negative")
        .otherwise("observed")
    )
    return F.struct(F.when(status == "observed", F.ln(number)).alias("value"), status.alias("status"))


def numeric_cell(text: Column) -> Column:
    """A struct of ``value`` and ``status`` of a workbook's cell; what is neither number nor mark is an error."""
    number = F.trim(text).try_cast("double")
    status = F.when(text.isNull() | (F.trim(text) == ""), "missing").when(number.isNotNull(), "observed").when(text.rlike(r"^\s*(?:\.{3}|…)"), "suppressed").otherwise(F.raise_error(F.lit("unexpected cell")).cast("string"))
    return F.struct(F.when(status == "observed", number).alias("value"), status.alias("status"))


def indicator_kind(text: Column) -> Column:
    """What a caption measures, or null."""
    t = F.lower(clean(text))
    small = t.contains(NO_SMALL)
    return (
        F.when(t.startswith(WAGE) & small, "wage")
        .when(t.startswith(HEADCOUNT) & small, "headcount")
        .when(t.startswith(EFFICIENCY_WAGE), "efficiency_wage")
        .when(t == POPULATION, "population")
        .when(t.startswith(POPULATION_AGE_SEX), "population_age_sex")
    )


def section_letter(text: Column) -> Column:
    """The Latin letter of a caption that begins with "Раздел X ", or null."""
    found = F.regexp_extract(text, r"^Раздел\s+(\S)\s", 1)
    return F.nullif(F.translate(found, LOOKALIKE_CYRILLIC, LOOKALIKE_LATIN), F.lit(""))


def broad_sector(text: Column, prefixes: dict[str, str]) -> Column:
    """The code of the first prefix that a sector's name has after its section letter, or null."""
    name = F.regexp_replace(F.lower(text), r"^раздел\s+[a-zа-я]\.?\s*", "")
    out = F.lit(None).cast("string")
    for code, prefix in reversed(list(prefixes.items())):
        out = F.when(name.startswith(prefix), code).otherwise(out)
    return out


def municipal_code(text: Column) -> Column:
    """The eight digits of a municipality's code; eleven must end in three noughts; else an error."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    bad = F.raise_error(F.concat(F.lit("not a municipal code: "), text)).cast("string")
    return F.when(F.length(digits) == 8, digits).when((F.length(digits) == 11) & digits.endswith("000"), F.substring(digits, 1, 8)).otherwise(bad)


def territory_id(value: Column) -> Column:
    """A territory's number without leading noughts; anything but digits is an error."""
    text = value.cast("string")
    digits = F.regexp_replace(text, "^0+(?=.)", "")
    return F.when(text.rlike("^[0-9]+$"), digits).otherwise(F.raise_error(F.concat(F.lit("not a territory id: "), F.coalesce(text, F.lit("null")))).cast("string"))


def month_start(text: Column, zone: str = "Europe/Moscow") -> Column:
    """The month's first day as YYYY-MM-DD, of a date or of a UTC stamp seen in ``zone``.

    Anything but the first of a month there, and null, is an error.  Stamps
    are told by their T, value by value.
    """
    stamp = F.from_utc_timestamp(F.to_timestamp(F.regexp_replace(text, "Z$", "")), zone)
    day = F.when(text.contains("T"), F.to_date(stamp)).otherwise(F.to_date(text, "yyyy-MM-dd"))
    bad = F.raise_error(F.concat(F.lit("not the start of a month: "), F.coalesce(text, F.lit("null")))).cast("string")
    return F.when(F.coalesce(F.dayofmonth(day) == 1, F.lit(False)), F.date_format(day, "yyyy-MM-dd")).otherwise(bad)


def local_year(stamp: Column, hours: int = 3) -> Column:
    """The year of a UTC stamp some hours further east."""
    return F.year(stamp + F.expr(f"interval {hours} hours"))


def content_hash(value: Column) -> Column:
    """SHA-256 of a text's UTF-8 or of bytes, in lower-case hex."""
    return F.sha2(value.cast("binary"), 256)


def canonical_json(*columns: Column | str) -> Column:
    """The columns as a JSON object in the order given, which is best that of their names."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def rounded_or_null(value: Column, places: int = 6) -> Column:
    """The number rounded; null if it is not finite."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.round(value, places))


def formatted_number(value: Column, digits: int = 0) -> Column:
    """A number with blanks between thousands and a decimal comma."""
    return F.translate(F.format_number(value, digits), ",.", " ,")


def formatted_percent(value: Column) -> Column:
    return F.concat(formatted_number(100 * value, 1), F.lit(" %"))


# The months as reports write them.
MONTHS = ("янв", "фев", "мар", "апр", "май", "июн", "июл", "авг", "сен", "окт", "ноя", "дек")


def formatted_month(period: Column) -> Column:
    """"янв 2023" of 2023-01-01."""
    return F.concat_ws(" ", F.element_at(F.array(*map(F.lit, MONTHS)), F.substring(period, 6, 2).cast("int")), F.substring(period, 1, 4))


def albers(lon: Column, lat: Column, parallels: tuple[float, float] = (50.0, 70.0), origin: tuple[float, float] = (100.0, 40.0)) -> tuple[Column, Column]:
    """x and y (down) of a place on a sphere of radius one, in the equal-area conic projection."""
    import math

    p1, p2 = map(math.radians, parallels)
    n = (math.sin(p1) + math.sin(p2)) / 2
    c = math.cos(p1) ** 2 + 2 * n * math.sin(p1)
    start = math.sqrt(c - 2 * n * math.sin(math.radians(origin[1]))) / n
    rho = F.sqrt(c - 2 * n * F.sin(F.radians(lat))) / n
    theta = n * F.radians(lon - origin[0])
    return rho * F.sin(theta), -(start - rho * F.cos(theta))
