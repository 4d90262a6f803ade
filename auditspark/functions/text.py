"""Text helpers: blanks, labels and renderings used by every operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import presets

# Every character that counts as white space at the edge of a value.
WHITESPACE = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
              "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
TAIL = "fields"


def ref(name: str) -> Column:
    """A column by its literal name; names of this format contain dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def non_blank(c: Column) -> Column:
    """The stripped text, or NULL when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def is_populated(c: Column) -> Column:
    return F.coalesce(strip(c) != "", F.lit(False))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def typed_column(df: DataFrame, name: str) -> str | None:
    """The actual spelling of a column, matched without regard to case."""
    return next((c for c in df.columns if c.lower() == name.lower()), None)


def text_of(df: DataFrame, name: str) -> Column:
    """A column as text; NULL stays NULL because it means *absent*."""
    kind = df.schema[name].dataType
    c = ref(name)
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(c), F.lit("")).otherwise(c.cast("string"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return iso_text(c.cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(c)
    return c.cast("string")


def to_text(df: DataFrame, name: str) -> Column:
    """Every scalar as text; NULL and NaN become blank."""
    return F.coalesce(text_of(df, name), F.lit(""))


def tail_value(tail: Column, name: str) -> Column:
    """An entry of a tail map: exactly so named, else the first whose name differs in case only."""
    folded = F.map_values(F.map_filter(tail, lambda k, _: F.lower(k) == name.lower()))
    return F.coalesce(F.try_element_at(tail, F.lit(name)), F.get(folded, 0))


def field(df: DataFrame, name: str, tail: str = TAIL) -> Column:
    """One named field of a record without regard to case: its column, else its entry in the tail map, else NULL."""
    options = []
    column = typed_column(df, name)
    if column is not None:
        options.append(text_of(df, column))
    if tail in df.columns:
        options.append(tail_value(ref(tail), name))
    if not options:
        return F.lit(None).cast("string")
    return options[0] if len(options) == 1 else F.coalesce(*options)


def first_populated(df: DataFrame, names: list[str]) -> Column:
    """The stripped text of the first field that holds something."""
    return F.coalesce(*[non_blank(field(df, n)) for n in names], F.lit(None).cast("string"))


def shorten(c: Column, limit: int = 320) -> Column:
    """Collapse white space and cut long text with an ellipsis."""
    clean = strip(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))
    cut = F.regexp_replace(clean, rf"(?s)^(.{{{limit - 1}}}).{{2,}}$", "$1…")
    return F.when(F.length(c) <= limit, clean).otherwise(cut)  # most texts are short


def first_text(df: DataFrame, names: list[str], limit: int = 320) -> Column:
    """First non-blank field, collapsed and shortened; NULL when there is none."""
    fields = [field(df, n) for n in names]
    return shorten(F.coalesce(*[F.when(is_populated(f), f) for f in fields], F.lit(None).cast("string")), limit)


def truthy(c: Column) -> Column:
    """R27."""
    return F.coalesce(F.lower(strip(c)).isin(presets.TRUE_WORDS), F.lit(False))


def falsey(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)).isin(presets.FALSE_WORDS), F.lit(False))


def country_key(c: Column) -> Column:
    """Letters only, with the synonyms of one country unified."""
    key = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]", "")
    return F.when(key.isin(list(presets.COUNTRY_SYNONYMS)), F.lit("unitedstates")).otherwise(key)


def compact(c: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")


def iso_text(ts: Column) -> Column:
    """ISO time in UTC, with microseconds only where there are some."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(ts), F.lit(1000000))
    return F.when(micros == 0, F.concat(whole, F.lit("+00:00"))).otherwise(
        F.concat(whole, F.lit("."), F.lpad(micros.cast("string"), 6, "0"), F.lit("+00:00")))


def hundredths_of_hours(micros: Column) -> Column:
    """Hours rounded half up to two places, as a whole number of hundredths."""
    return F.floor((micros + F.lit(18000000)) / F.lit(36000000)).cast("bigint")


def two_places(hundredths: Column) -> Column:
    """Render whole hundredths as ``12.34``."""
    whole = F.floor(hundredths / F.lit(100)).cast("bigint").cast("string")
    return F.concat(whole, F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"))
