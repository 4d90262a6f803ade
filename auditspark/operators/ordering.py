"""Previous events, positions, review order, pages.

A window over one key would put a key that holds a third of all rows into one task, and a window without a key all rows.
The operators here deal rows out by *ranges* of the whole order, ties broken to the end, so that equal values are cut like
others.  The borders come from a bounded sample.  One window works within each range; what one range hands to the next
(totals, last rows) is a table of at most one row per range.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .. import presets
from ..functions.predicates import is_time_like
from ..functions.text import non_blank, ref, strip, text_of
from ..functions.times import parse_sortable_time, time_of
from pyspark.sql import types as T

HOUR_MICROS = 3600 * 1000000
MOST_RANGES = 4096
LEAST_ROWS = 1 << 18  # of a range, unless the caller asks for a number of ranges
SAMPLED_ROWS = 24   # of each range, about
_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


@dataclass(frozen=True)
class Key:
    """A sort column.  Nulls come first, and last where it falls."""
    value: Column
    descending: bool = False

    @property
    def order(self) -> Column:
        return self.value.desc() if self.descending else self.value.asc()


@dataclass(frozen=True)
class Borders:
    """The first keys of all ranges but the first."""
    rows: list[tuple]
    kinds: list[str]

    def column(self, place: int) -> Column:
        """One field of all borders as an array."""
        return F.array(*[F.lit(r[place]).cast(self.kinds[place]) for r in self.rows])


def sample_borders(df: DataFrame, keys: Sequence[Key], ranges: int | None = None, total: int | None = None,
                   prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Borders:
    """Borders that cut ``df`` into about equal ranges of these keys: a count and a bounded sample, which the driver sees.

    Any borders give right results; these give even ones.  ``total`` is the number of rows, where it is known; ``prepare``
    adds the columns that the keys need, to the sampled rows alone.
    """
    names = [f"__k{i}" for i in range(len(keys))]

    def keyed(rows: DataFrame) -> DataFrame:
        return prepare(rows).select(*[k.value.alias(n) for k, n in zip(keys, names)])

    kinds = [f.dataType.simpleString() for f in keyed(df).schema]
    total = df.count() if total is None else total
    if ranges is None:
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranges = min(4 * tasks, MOST_RANGES, total // LEAST_ROWS + 1)
    ranges = min(ranges, MOST_RANGES)
    if ranges < 2 or not total:
        return Borders([], kinds)
    share = min(1.0, SAMPLED_ROWS * ranges / total)
    order = [Key(F.col(n), k.descending).order for k, n in zip(keys, names)]
    sampled = keyed(df if share == 1.0 else df.sample(share, seed=17))
    # A bounded sample sorts in one task; a sort by ranges would read the table twice.
    seen = [tuple(r) for r in sampled.repartition(1).sortWithinPartitions(*order).collect()]
    picked = [seen[i * len(seen) // ranges] for i in range(1, ranges)] if seen else []
    return Borders([r for i, r in enumerate(picked) if not i or repr(r) != repr(picked[i - 1])], kinds)


def _range_of(keys: Sequence[Key], borders: Borders) -> Column:
    """How many borders are at or before the row: a binary search."""
    count = len(borders.rows)
    if not count:
        return F.lit(0)
    fields = [borders.column(i) for i in range(len(keys))]

    def reached(place: Column) -> Column:
        found = F.lit(True)
        for key, values in reversed(list(zip(keys, fields))):
            border = F.element_at(values, place)
            before = border > key.value if key.descending else border < key.value
            missing = key.value.isNull() if key.descending else border.isNull()  # one of the two is null
            found = F.when(border.eqNullSafe(key.value), found).otherwise(F.coalesce(before, missing))
        return found

    def step(at: Column, width: Column) -> Column:
        ahead = F.least(at + width, F.lit(count))  # never beyond the last border
        return F.when((at + width <= count) & reached(ahead), at + width).otherwise(at)

    return F.aggregate(F.array(*[F.lit(1 << b) for b in range(count.bit_length() - 1, -1, -1)]), F.lit(0), step)


@dataclass(frozen=True)
class Dealt:
    """Rows with their range; the names of their partition's columns and of their sort keys."""
    rows: DataFrame
    parts: list[str]
    keys: list[Key]
    crossing: Column  # the row's partition goes over a border of its range
    cut: bool  # there are several ranges

    @property
    def order(self) -> list[Column]:
        return [k.order for k in self.keys]

    def within(self):
        return Window.partitionBy("__range", *self.parts).orderBy(*self.order)

    def handed_on(self, totals: Mapping[str, Column], handed: Mapping[str, Column]) -> DataFrame:
        """For each range that continues a partition (at most one per range) what ``handed`` says of the ranges before.

        Rows that cross no border meet in one group, which goes once it is added up.  A filter on the rows would move below
        the keys, where every step of the search for a range computes them anew.
        """
        groups = [F.when(self.crossing, F.col(c)).alias(c) for c in ("__range", *self.parts)]
        own = (self.rows.filter(F.lit(self.cut)).groupBy(*groups)
               .agg(*[c.alias(n) for n, c in totals.items()], F.max(self.crossing).alias("__crosses")).filter("__crosses"))
        names = [f"__from{i}" for i in range(len(self.parts))]
        found = own.select(F.col("__range").alias("__to"), *[F.col(p).alias(n) for p, n in zip(self.parts, names)],
                           *[c.alias(n) for n, c in handed.items()])
        given = [F.col(n).isNotNull() for n in handed]
        return F.broadcast(found.filter(reduce(lambda a, b: a | b, given)))

    def before(self):
        return Window.partitionBy(*self.parts).orderBy("__range")

    def joined(self, rows: DataFrame, handed: DataFrame) -> DataFrame:
        same = F.col("__range") == F.col("__to")
        for i, p in enumerate(self.parts):
            same = same & F.col(p).eqNullSafe(F.col(f"__from{i}"))
        return rows.join(handed, same, "left").drop("__to", *[f"__from{i}" for i in range(len(self.parts))])

    @property
    def helpers(self) -> list[str]:
        return ["__range", *self.parts, *[f"__k{i}" for i in range(len(self.keys))]]


def deal_ranges(df: DataFrame, partition: Sequence[Column], keys: Sequence[Key], ranges: int | None = None,
                borders: Borders | None = None) -> Dealt:
    """Rows dealt out by ranges of (partition, keys); keys are computed once."""
    parts, names = [f"__p{i}" for i in range(len(partition))], [f"__k{i}" for i in range(len(keys))]
    keyed = df.withColumns({**dict(zip(parts, partition)), **{n: k.value for n, k in zip(names, keys)}})
    own = [Key(F.col(n), k.descending) for n, k in zip(names, keys)]
    whole = [*[Key(F.col(p)) for p in parts], *own]
    borders = sample_borders(keyed, whole, ranges) if borders is None else borders
    rows = keyed.withColumn("__range", _range_of(whole, borders))

    def at_border(place: Column) -> Column:
        inside = (place >= 1) & (place <= len(borders.rows))
        valid = F.greatest(F.lit(1), F.least(place, F.lit(len(borders.rows))))
        for i, p in enumerate(parts):
            inside = inside & F.element_at(borders.column(i), valid).eqNullSafe(F.col(p))
        return inside

    # Without parts every range goes on where the one before ended.
    crossing = at_border(F.col("__range")) | at_border(F.col("__range") + 1) if parts and borders.rows else F.lit(True)
    return Dealt(rows, parts, own, crossing, bool(borders.rows))


def with_running(df: DataFrame, keys: Sequence[Key], values: Mapping[str, Column], partition: Sequence[str] = (),
                 ranges: int | None = None, borders: Borders | None = None, greatest: bool = False) -> DataFrame:
    """Running sums in the whole order (per ``partition``), the row's own value included, as columns named like ``values``;
    with ``greatest`` the greatest value so far instead of the sum, nulls left out.

    Nulls are keys like others, in partitions too; no row is lost.  ``borders`` of (partition, keys) can serve several calls.
    """
    return _running(deal_ranges(df, [ref(p) for p in partition], keys, ranges, borders), values, greatest)


def with_runs(df: DataFrame, keys: Sequence[Key], member: Column, name: str, ranges: int | None = None, borders: Borders | None = None) -> DataFrame:
    """How many runs of members have begun up to a row in the whole order, as column ``name``: members without another row
    between them make up a run, or several where borders cut it."""
    dealt = deal_ranges(df.withColumn("__member", member), [], keys, ranges, borders)
    begins = F.col("__member") & ~F.coalesce(F.lag("__member").over(dealt.within()), F.lit(False))
    rows = dealt.rows.withColumn("__begins", begins.cast("bigint"))
    return _running(replace(dealt, rows=rows), {name: F.col("__begins")}).drop("__member", "__begins")


def _running(dealt: Dealt, values: Mapping[str, Column], greatest: bool = False) -> DataFrame:
    total = F.max if greatest else F.sum
    sofar = dealt.within().rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.rows.withColumns({f"__in_{n}": total(v).over(sofar) for n, v in values.items()})
    earlier = dealt.before().rowsBetween(Window.unboundedPreceding, -1)
    handed = dealt.handed_on({f"__all_{n}": total(v) for n, v in values.items()},
                             {f"__before_{n}": total(f"__all_{n}").over(earlier) for n in values})

    def joined(own: Column, before: Column) -> Column:
        return F.greatest(own, before) if greatest else own + F.coalesce(before, F.lit(0))

    found = {n: joined(F.col(f"__in_{n}"), F.col(f"__before_{n}")) for n in values}
    return (dealt.joined(rows, handed).withColumns(found)
            .drop(*dealt.helpers, *[f"__{k}_{n}" for n in values for k in ("in", "before")]))


def with_position(df: DataFrame, keys: Sequence[Key], name: str, partition: Sequence[str] = (), ranges: int | None = None,
                  borders: Borders | None = None) -> DataFrame:
    """1-based position in the whole order (per ``partition``), without a one-task sort."""
    return with_running(df, keys, {name: F.lit(1)}, partition, ranges, borders).withColumn(name, F.col(name).cast("bigint"))


def with_row_ids(df: DataFrame, natural_key: str, name: str = "_Row", partition: Sequence[str] = (),
                 ranges: int | None = None) -> DataFrame:
    """W1 for a natural key: source ordinals per dataset."""
    return with_position(df, [Key(ref(natural_key))], name, partition, ranges)


def with_previous(df: DataFrame, key: Sequence[str], order: Sequence[Column], payload: Column, name: str, keep=None,
                  ranges: int | None = None, borders: Borders | None = None) -> DataFrame:
    """``payload`` of the previous row of the same key as column ``name`` (NULL for the first row).

    ``order`` lists ascending columns and ``payload`` is never NULL.  A key that holds many rows goes over many ranges, whatever
    their order values; each range gets the last row of the one before.
    ``keep(previous)`` says which rows the caller wants; others, and rows without a predecessor, are dropped.
    """
    keyed = df.withColumn("__payload", payload)
    dealt = deal_ranges(keyed, [ref(k) for k in key], [Key(c) for c in order], ranges, borders)
    rows = dealt.rows.withColumn(name, F.lag("__payload").over(dealt.within()))
    last = F.max_by("__payload", F.struct(*[k.value for k in dealt.keys]))
    handed = dealt.handed_on({"__last": last}, {"__earlier": F.lag("__last").over(dealt.before())})
    found = dealt.joined(rows, handed).withColumn(name, F.coalesce(F.col(name), F.col("__earlier")))
    wanted = F.lit(True) if keep is None else F.col(name).isNotNull() & F.coalesce(keep(F.col(name)), F.lit(False))
    return found.filter(wanted).drop("__payload", "__earlier", *dealt.helpers)


def first_by(df: DataFrame, key: Sequence[Column], order: Column, names: Sequence[str]) -> DataFrame:
    """One row per key, the first in order; combines before the shuffle, so a hot key is no burden."""
    picked = F.min_by(F.struct(*[ref(n) for n in names]), order)
    keys = [k.alias(f"__k{i}") for i, k in enumerate(key)]
    return df.groupBy(*keys).agg(picked.alias("__first")).select(*[
        F.col("__first")[n].alias(n) for n in names])


@dataclass(frozen=True)
class ReviewOrder:
    """Derived key columns and the sort keys over them.  The keys are parsed once per row by ``attach``."""
    columns: dict[str, Column]
    keys: list[Key]

    @property
    def order(self) -> list[Column]:
        return [k.order for k in self.keys]

    def attach(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.columns) if self.columns else df

    def detach(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.columns)


def _kind(column: str, row_id: str) -> str:
    if is_time_like(column):
        return "time"
    if column == row_id or column.endswith((".Score", ".DomainAgeDays")):
        return "number"
    return "risk" if column.endswith(".Risk") else "none"


def review_order(df: DataFrame, column: str = "", direction: str = "asc", *, row_id: str = "_Row",
                 kind: str | None = None) -> ReviewOrder:
    """O1-O3: order of a reviewed column; blanks always last, ties in source order.

    Columns that are neither times nor scores nor risks leave the source order unchanged.
    """
    descending = direction == "desc"
    source = Key(ref(row_id))
    kind = (kind or _kind(column, row_id)) if column else "none"
    if kind == "none":
        return ReviewOrder({}, [source])
    if column == row_id and kind == "number":  # ids are numbers, none of them blank
        return ReviewOrder({}, [Key(ref(row_id), descending)])
    text = text_of(df, column)
    number = F.col("__number")

    def built(value: Column, late: Column, loose_rank: int, blank_rank: int, value_rank: int, plain: Column) -> ReviewOrder:
        """Ranks of values, unreadable texts and blanks."""
        blank = non_blank(text).isNull()
        columns = {"__number": F.when(~blank, value), "__blank": blank}
        columns["__rank"] = F.when(F.col("__blank"), F.lit(blank_rank)).when(late, F.lit(loose_rank)).otherwise(F.lit(value_rank))
        columns["__loose"] = F.when(F.col("__rank") == loose_rank, plain)
        return ReviewOrder(columns, [Key(F.col("__rank")), Key(number, descending), Key(F.col("__loose"), descending), source])

    if kind == "time":
        typed = isinstance(df.schema[column].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
        moment = F.unix_micros(time_of(df, column) if typed else parse_sortable_time(text))
        return built(moment, number.isNull(), 1, 2, 0, F.lower(text))
    if kind == "number":
        value = F.when(strip(text).rlike(_NUMBER), strip(text).try_cast("double"))
        late, early = (0, 1) if descending else (1, 0)
        return built(value, number.isNull(), late, 2, early, text)
    level = F.lower(strip(text))
    value = F.coalesce(*[F.when(level == w, F.lit(v)) for w, v in presets.RISK_ORDER.items()], F.lit(0))
    late, early = (1, 0) if descending else (0, 1)
    return built(value, number == 0, late, 2, early, level)


def sort_rows(df: DataFrame, column: str = "", direction: str = "asc", **options) -> DataFrame:
    """O1-O3."""
    spec = review_order(df, column, direction, **options)
    return spec.detach(spec.attach(df).orderBy(*spec.order))


def sorted_positions(df: DataFrame, column: str = "", direction: str = "asc", name: str = "position", *,
                     ranges: int | None = None, **options) -> DataFrame:
    """O1-O3 as a position column over the whole table."""
    spec = review_order(df, column, direction, **options)
    borders = sample_borders(df, spec.keys, ranges, prepare=spec.attach)
    return spec.detach(with_position(spec.attach(df), spec.keys, name, borders=borders))


def sorted_page(df: DataFrame, column: str = "", direction: str = "asc", page: int = 1, size: int = 50,
                **options) -> DataFrame:
    """One page of the review order."""
    spec = review_order(df, column, direction, **options)
    return spec.detach(page_rows(spec.attach(df), spec.order, page, size))


def page_rows(df: DataFrame, order: Sequence[Column], page: int = 1, size: int = 50) -> DataFrame:
    """One page; the page starts at 1 and the size is kept within 10..500."""
    page, size = max(1, int(page)), min(500, max(10, int(size)))
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def page_after(df: DataFrame, order: Sequence[Column], beyond: Column, size: int = 50) -> DataFrame:
    """O4 for deep pages: the caller passes a predicate for what follows the last row seen."""
    return df.filter(beyond).orderBy(*order).limit(min(500, max(10, int(size))))


def sorted_page_after(df: DataFrame, column: str, direction: str, last: Row | None, size: int = 50, *, row_id: str = "_Row",
                      **options) -> DataFrame:
    """O1-O4 for deep pages: the page that follows ``last``, the last row of a page of this function (None: the first page).

    Pages carry the sort keys in ``__rank``, ``__number`` and ``__loose``, so that no page has to skip the rows before it.
    """
    spec = review_order(df, column, direction, row_id=row_id, **options)
    keyed = spec.attach(df)
    falling = direction == "desc"
    names = [("__rank", False), ("__number", falling), ("__loose", falling)] if spec.columns else []
    fields = [*names, (row_id, falling and not spec.columns and column == row_id)]
    beyond, same = F.lit(last is None), F.lit(True)
    for name, down in fields if last is not None else ():
        value = last[name]
        if value is not None:  # within a rank, a key is null in all rows or in none
            beyond = beyond | (same & (ref(name) < F.lit(value) if down else ref(name) > F.lit(value)))
        same = same & ref(name).eqNullSafe(F.lit(value))
    return page_after(keyed, spec.order, beyond, size)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """O5."""
    return df.orderBy(*order).limit(k)
