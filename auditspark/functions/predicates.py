"""Field predicates as composable Column expressions.

A field name is resolved as an alias (any of its columns), else as an exact column name, else
as part of column names.  NULL means the record has no such field; ``''`` means it has it and
the field is blank.  Absent alias columns read as blank, so a blank test on an alias passes
when any of its columns is missing.  Exact and partial names are resolved per record: the tail
map (``fields``) takes part with the keys the record really has.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from datetime import timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import presets
from .text import TAIL, compact, field, is_populated, ref, strip, text_of
from .times import literal_micros, literal_time, parse_time

Test = Callable[[Column], Column]
_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def any_of(*tests: Column) -> Column:
    """F9."""
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def all_of(*tests: Column) -> Column:
    """F9; AND binds tighter than OR because grouping is explicit."""
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def negate(test: Column) -> Column:
    """passes unless the test holds; a record without the field passes."""
    return ~_yes(test)


def _value_columns(df: DataFrame, tail: str) -> list[str]:
    return [c for c in df.columns if c != tail]


def _hit(df: DataFrame, name: str, test: Callable[[Column, str | None], Column], tail: str,
         absent: Column | None = None) -> Column:
    """``test`` on every value the name resolves to; ``absent`` answers when there is no value."""
    aliases = presets.FIELD_ALIASES.get(name.lower())
    if aliases:
        known = {c.lower(): c for c in df.columns}
        tests = []
        for alias in aliases:
            column = known.get(alias.lower())
            if column is None and tail not in df.columns:
                tests.append(test(F.lit(""), None))
            else:
                tests.append(_yes(test(F.coalesce(field(df, alias, tail), F.lit("")),
                                       None if tail in df.columns else column)))
        return any_of(*tests)
    wanted = name.lower()
    exact = [c for c in _value_columns(df, tail) if c.lower() == wanted]
    partial = [c for c in _value_columns(df, tail) if wanted in c.lower() and c not in exact]

    def typed(columns: list[str]) -> list[Column]:
        return [_yes(test(text_of(df, c), c)) for c in columns]

    exact_hits, exact_present = typed(exact), [ref(c).isNotNull() for c in exact]
    partial_hits, partial_present = typed(partial), [ref(c).isNotNull() for c in partial]
    if tail in df.columns:
        def in_tail(keys: Callable[[Column], Column]) -> tuple[Column, Column]:
            part = F.map_values(F.map_filter(ref(tail), lambda k, _: keys(F.lower(k))))
            return (_yes(F.exists(part, lambda v: _yes(test(F.coalesce(v, F.lit("")), None)))),
                    _yes(F.size(part) > 0))
        hit, present = in_tail(lambda k: k == wanted)
        exact_hits.append(hit)
        exact_present.append(present)
        hit, present = in_tail(lambda k: k.contains(wanted) & (k != wanted))
        partial_hits.append(hit)
        partial_present.append(present)
    if not partial_hits:
        result = any_of(*exact_hits)
    elif not exact_hits:
        result = any_of(*partial_hits)
    else:
        result = F.when(any_of(*exact_present), any_of(*exact_hits)).otherwise(any_of(*partial_hits))
    if absent is None:
        return result
    present = exact_present + partial_present
    return result | (~any_of(*present) & absent) if present else absent


def field_equals(df: DataFrame, name: str, value: str, tail: str = TAIL) -> Column:
    """F2; the blank value is the blank test."""
    if value == "":
        return field_is_blank(df, name, tail)
    return _hit(df, name, lambda v, _: F.lower(v) == F.lower(F.lit(value)), tail)


def field_contains(df: DataFrame, name: str, value: str, tail: str = TAIL) -> Column:
    """F3; a ``*`` in the value makes it a whole-value pattern."""
    if "*" in value:
        return field_like(df, name, value, tail)
    return _hit(df, name, lambda v, _: F.lower(v).contains(F.lower(F.lit(value))), tail)


def _whole_value_pattern(value: str) -> str:
    quoted = [re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", piece) for piece in value.split("*")]
    return r"(?iud)\A" + ".*".join(quoted) + r"\z"


def field_like(df: DataFrame, name: str, value: str, tail: str = TAIL) -> Column:
    """``*`` stands for any text within a line."""
    pattern = _whole_value_pattern(value)
    return _hit(df, name, lambda v, _: v.rlike(pattern), tail)


def field_is_blank(df: DataFrame, name: str, tail: str = TAIL) -> Column:
    """absent or exactly blank."""
    return _hit(df, name, lambda v, _: v == "", tail, absent=F.lit(True))


def field_is_populated(df: DataFrame, name: str, tail: str = TAIL) -> Column:
    return negate(field_is_blank(df, name, tail))


_OPERATORS = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}


def field_compare(df: DataFrame, name: str, operator: str, value: str, tail: str = TAIL) -> Column:
    """as times, else as numbers, else as text; a pair of different kinds compares as text.

    Typed numeric and time columns compare natively, so the test reaches the scan.
    """
    compare = _OPERATORS[operator]
    if str(value).strip() == "":
        raise ValueError(f"Query field '{name}' is missing a value")
    moment = literal_time(value)
    number = None
    if moment is None:
        try:
            number = float(str(value).strip())
        except ValueError:
            pass

    def native(column: str) -> Column | None:
        kind = df.schema[column].dataType
        if number is not None and isinstance(kind, T.NumericType):
            whole = isinstance(kind, T.IntegralType) and number.is_integer() and abs(number) < 2 ** 63
            return compare(ref(column), F.lit(int(number) if whole else number))
        if moment is not None and isinstance(kind, T.TimestampNTZType):
            naive = moment.astimezone(timezone.utc).replace(tzinfo=None)
            return compare(ref(column), F.lit(naive.isoformat(sep=" ")).cast("timestamp_ntz"))
        if moment is not None and isinstance(kind, (T.TimestampType, T.DateType)):
            return compare(ref(column).cast("timestamp"), F.timestamp_micros(F.lit(literal_micros(moment))))
        return None

    named = _only_column(df, name, tail)
    if named is not None and native(named) is not None:
        return native(named)

    def as_number(v: Column) -> Column:
        return F.when(strip(v).rlike(_NUMBER), strip(v).try_cast("double"))

    def test(v: Column, column: str | None) -> Column:
        direct = native(column) if column else None
        if direct is not None:
            return direct
        as_text = compare(F.lower(v), F.lower(F.lit(str(value))))
        when = parse_time(v)
        if moment is not None:
            result = F.when(when.isNotNull(), compare(F.unix_micros(when), F.lit(literal_micros(moment)))
                            ).otherwise(as_text)
        elif number is not None:
            result = F.when(when.isNotNull(), as_text).when(
                as_number(v).isNotNull(), compare(as_number(v), F.lit(number))).otherwise(as_text)
        else:
            plain = compare(F.lower(strip(v)), F.lower(F.lit(str(value).strip())))
            result = F.when(when.isNotNull() | as_number(v).isNotNull(), as_text).otherwise(plain)
        return (strip(v) != "") & result

    return _hit(df, name, test, tail)


def _only_column(df: DataFrame, name: str, tail: str) -> str | None:
    """The column a name means when nothing else can: one known alias column or one exact name."""
    if tail in df.columns:
        return None
    aliases = presets.FIELD_ALIASES.get(name.lower())
    wanted = {a.lower() for a in aliases} if aliases else {name.lower()}
    found = [c for c in df.columns if c.lower() in wanted]
    partial = [] if aliases else [c for c in df.columns if name.lower() in c.lower() and c not in found]
    return found[0] if len(found) == 1 and not partial else None


def before(df: DataFrame, name: str, moment: str, tail: str = TAIL) -> Column:
    """F14."""
    return field_compare(df, name, "<", moment, tail)


def after(df: DataFrame, name: str, moment: str, tail: str = TAIL) -> Column:
    """F14."""
    return field_compare(df, name, ">", moment, tail)


def any_field_contains(df: DataFrame, value: str, tail: str = TAIL, columns: list[str] | None = None) -> Column:
    """F8: a bare term over every value of the record."""
    if "*" in value:
        pattern = _whole_value_pattern(value)
        def test(v): return v.rlike(pattern)
    else:
        def test(v): return F.lower(v).contains(F.lower(F.lit(value)))
    tests = [_yes(test(text_of(df, c))) for c in (columns or _value_columns(df, tail))]
    if tail in df.columns:
        tests.append(_yes(F.exists(F.map_values(ref(tail)), lambda v: _yes(test(v)))))
    return any_of(*tests)


def operation_is(value: str, operation: str = "Operation") -> Column:
    """exact spelling; reaches the scan as a pushed filter."""
    return ref(operation) == F.lit(value)


def value_selection(df: DataFrame, name: str, include: Iterable[str] = (), exclude: Iterable[str] = (),
                    tail: str = TAIL) -> Column:
    """included values are alternatives, every excluded value is ruled out."""
    def any_value(chosen: list[str]) -> Column:
        texts = sorted({v.lower() for v in chosen if v != ""})
        tests = [_hit(df, name, lambda v, _: F.lower(v).isin(texts), tail)] if texts else []
        return any_of(*tests, *([field_is_blank(df, name, tail)] if "" in chosen else []))

    wanted, unwanted = list(include), list(exclude)
    return all_of(*([any_value(wanted)] if wanted else []), *([negate(any_value(unwanted))] if unwanted else []))


def has_any_value(df: DataFrame, columns: list[str] | None = None, tail: str = TAIL) -> Column:
    """F16: the record holds at least one populated value."""
    tests = [is_populated(text_of(df, c)) for c in (columns or _value_columns(df, tail))]
    if columns is None and tail in df.columns:
        tests.append(_yes(F.exists(F.map_values(ref(tail)), is_populated)))
    return any_of(*tests)


def is_time_like(name: str) -> bool:
    return name.lower() == "received" or bool(re.search("time|date", name, re.I))


def header_key(name: str) -> str:
    return re.sub("[^a-z0-9]", "", name.lower())


__all__ = ["after", "all_of", "any_field_contains", "any_of", "before", "compact", "field_compare", "field_contains",
           "field_equals", "field_is_blank", "field_is_populated", "field_like", "has_any_value", "header_key",
           "is_time_like", "negate", "operation_is", "value_selection"]


def selected_rows(df: DataFrame, name: str, values: DataFrame, excluded: DataFrame | None = None, *, value: str = "value",
                  tail: str = TAIL) -> DataFrame:
    """F13 for large selections: rows whose field is in a table of values and not in another, without regard to case.

    Two keyed joins; the lists may be as long as the data.  Null or missing fields count as blank.
    """
    def listed(table: DataFrame) -> DataFrame:
        return table.select(F.lower(F.coalesce(ref(value).cast("string"), F.lit(""))).alias("__value")).distinct()

    keyed = df.withColumn("__value", F.lower(F.coalesce(field(df, name, tail), F.lit(""))))
    kept = keyed.join(listed(values), "__value", "left_semi")
    if excluded is not None:
        kept = kept.join(listed(excluded), "__value", "left_anti")
    return kept.drop("__value")
