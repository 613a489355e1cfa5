"""Cell values as columns: typing, safe casts, parsing, normalisation. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldweave.functions import lexicon as L
from fieldweave.functions import names as N

NUMBER = r"^[-+]?\d+([.,]\d+)?$"
LOOSE_NUMBER = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"
DATE_ANYWHERE = r"\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4}"


def visible(value: Column) -> Column:
    return value.isNotNull() & (F.trim(value) != "")


def value_type(value: Column) -> Column:
    """null, boolean, number, date or string, by the value's spelling."""
    plain = F.trim(value)
    number = F.replace(F.replace(plain, F.lit(" "), F.lit("")), F.lit(","), F.lit("."))
    return (
        F.when(~visible(value) | value.isNull(), "null")
        .when(F.lower(plain).isin(L.SAMPLE_BOOLEANS), "boolean")
        .when(number.rlike(LOOSE_NUMBER), "number")
        .when((F.length(plain) >= 8) & plain.rlike(DATE_ANYWHERE), "date")
        .otherwise("string")
    )


def to_number(value: Column) -> Column:
    """The transform's number: blanks dropped, comma as point; NULL where that is no number."""
    plain = F.replace(F.replace(F.trim(value), F.lit(" "), F.lit("")), F.lit(","), F.lit("."))
    return F.when(plain.rlike(LOOSE_NUMBER), plain.try_cast("double"))


def to_boolean(value: Column) -> Column:
    """The transform's boolean: four true words, all else false; NULL stays NULL."""
    return F.when(value.isNotNull(), F.lower(F.trim(value)).isin(L.TRUE_WORDS))


def parse_number(value: Column) -> Column:
    """A number with a comma or point; blanks inside are dropped."""
    plain = F.replace(F.trim(value), F.lit(" "), F.lit(""))
    return F.when(plain.rlike(NUMBER), F.replace(plain, F.lit(","), F.lit(".")).try_cast("double"))


def parse_boolean(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return F.when(low.isin(L.INFERRED_TRUE), True).when(low.isin(L.INFERRED_FALSE), False)


def parse_date(value: Column) -> Column:
    """ISO text of a date in one of four spellings; NULL otherwise."""
    plain = F.trim(value)
    tries = [F.when(plain.rlike(shape), F.try_to_date(plain, fmt)) for shape, fmt in ((r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{2}\.\d{2}\.\d{4}$", "dd.MM.yyyy"), (r"^\d{2}/\d{2}/\d{4}$", "dd/MM/yyyy"), (r"^\d{2}-\d{2}-\d{4}$", "dd-MM-yyyy"))]
    return F.date_format(F.coalesce(*tries), "yyyy-MM-dd")


# Digits by the signs they are misread as, in numbers and in dates.
NUMBER_SIGNS, NUMBER_DIGITS = "оОoOIl|SsB", "0000111558"
DATE_SIGNS, DATE_DIGITS = "оОoOIl|", "0000111"
# Letters that look alike in both scripts.
LATIN_ALIKE, CYRILLIC_ALIKE = "AaBCcEeHKMOoPpTXxYy", "АаВСсЕеНКМОоРрТХхУу"
# Words that stand for no value.
PLACEHOLDERS = ["", "-", "—", "n/a", "na", "null", "none", "undefined", "unknown"]


def repair_number(value: Column) -> Column:
    """A number after common misreadings of its digits; NULL if it still is none."""
    plain = F.replace(F.translate(F.trim(value), NUMBER_SIGNS, NUMBER_DIGITS), F.lit(" "), F.lit(""))
    plain = F.translate(plain, "−—", "--")
    return F.when(plain.rlike(r"^[-+]?\d+([.,]\d+)?$"), F.replace(plain, F.lit(","), F.lit(".")))


def repair_date(value: Column) -> Column:
    """ISO text of a date, year first or last, after common misreadings of its digits; NULL if it still is none."""
    plain = F.regexp_replace(F.regexp_replace(F.translate(F.trim(value), DATE_SIGNS, DATE_DIGITS), r"[./\\]", "-"), r"\s+", "")
    shape = r"^(\d{1,4})-(\d{1,2})-(\d{1,4})$"
    first, middle, last = (F.regexp_extract(plain, shape, k) for k in (1, 2, 3))
    iso = lambda y, m, d: F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    found = F.when((F.length(first) == 4) & (F.length(last) <= 2), iso(first, middle, last)).when((F.length(last) == 4) & (F.length(first) <= 2), iso(last, middle, first))
    return F.date_format(F.try_to_date(F.when(plain.rlike(shape) & ~found.startswith("0000"), found), "yyyy-MM-dd"), "yyyy-MM-dd")


def one_script(value: Column) -> Column:
    """Letters that look alike in Latin and Cyrillic, all in the script that has more of the value's letters; Cyrillic on a tie."""
    plain = F.trim(F.coalesce(value, F.lit("")))
    cyrillic, latin = F.regexp_count(plain, F.lit("[а-яА-ЯёЁ]")), F.regexp_count(plain, F.lit("[a-zA-Z]"))
    return F.when((cyrillic == 0) | (latin == 0), plain).when(cyrillic >= latin, F.translate(plain, LATIN_ALIKE, CYRILLIC_ALIKE)).otherwise(F.translate(plain, CYRILLIC_ALIKE, LATIN_ALIKE))


def is_placeholder(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value, F.lit("")))).isin(PLACEHOLDERS)


def representative(values: Column, kind: Column, total: Column) -> Column:
    """The value that stands for a column in a draft, from its filled ``values`` (array) of ``total``: the first that fits its type.

    NULL where a tenth or less of five or more rows are filled. Texts: a date, else one of 2 to 120 characters, else any that is no placeholder.
    """
    first = lambda xs: F.get(F.filter(xs, lambda x: x.isNotNull()), F.lit(0))
    plain = F.transform(values, lambda x: F.trim(x))
    texts = F.filter(plain, lambda x: ~is_placeholder(x))
    whole = lambda x: F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))
    number = first(F.transform(values, lambda x: whole(parse_number(x))))
    flag = first(F.transform(values, lambda x: parse_boolean(x).cast("string")))
    text = F.coalesce(first(F.transform(values, parse_date)), first(F.filter(texts, lambda x: (F.length(x) > 1) & (F.length(x) <= 120))), first(texts))
    sparse = (total >= 5) & (F.size(values) / total <= 0.1)
    return F.when((F.size(values) == 0) | sparse, F.lit(None).cast("string")).when(kind == "number", number).when(kind == "boolean", flag).otherwise(text)


def excel_header(value: Column, index: Column) -> Column:
    """A sheet's header as text; ``Column n`` where it is null or blank."""
    return F.when(visible(value), F.trim(value)).otherwise(F.concat(F.lit("Column "), index.cast("string")))


def is_code(value: Column) -> Column:
    """At most 16 characters without lower case and with a digit."""
    plain = F.trim(F.coalesce(value, F.lit("")))
    return (F.length(plain) <= 16) & (F.upper(plain) == plain) & plain.rlike(r"\p{Nd}")


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up, at least 1; 0 for empty or null text."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(n / 4))).cast("long")


def band_score(band: Column) -> Column:
    return F.when(band == "high", 1.0).when(band == "medium", 0.7).when(band == "low", 0.4).otherwise(0.0)


def column_name(header: Column) -> Column:
    """A header as a camelCase key in Latin letters; one that begins with a digit gets ``field`` before it, an empty one is ``field``."""
    spaced = F.regexp_replace(F.trim(F.coalesce(header, F.lit(""))), r"(?<=[a-zа-я0-9])(?=[A-ZА-Я])", " ")
    words = F.filter(F.split(F.replace(F.lower(spaced), F.lit("ё"), F.lit("е")), r"[^a-zа-я0-9]+"), lambda w: w != "")
    words = F.transform(words, N.transliterated)
    joined = F.concat(F.coalesce(F.get(words, F.lit(0)), F.lit("")), F.array_join(F.transform(F.slice(words, F.lit(2), F.size(words)), F.initcap), ""))
    return F.when(joined.rlike(r"^[a-z]"), joined).otherwise(F.concat(F.lit("field"), joined))
