"""Facets and metrics from tables that merge.

Every source file has a part: how many rows it has of each operation, of each value of a list, of each column.  All of it
are counts by key, so parts of several files merge by adding, files come by appending their part and go by leaving it out,
and distinct values stay exact: a value is there while any part counts it.  Overviews read these tables, not the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import presets
from ..functions.categories import CATEGORIES, category_of, in_category
from ..functions.text import TAIL, field, is_populated, ref, to_text
from .facets import facets_of_cube

BROAD = ("logins", "teams", "files", "mail")
_OPERATION, _COLUMN = "operation", "column"


def facet_parts(df: DataFrame, source: Column, members: Mapping[str, Column], *, operation: str = "Operation", row_id: str = "_Row",
                values: Sequence[str] = (), tag: str = "Review.Tag", tail: str = TAIL) -> DataFrame:
    """(source, metric, value, kind, broad, n, first): the part of every source file.

    ``members`` are lists whose different values are counted (users, addresses, ...), ``values`` columns whose values are
    listed.  Everything is one pass whose rows collapse before the shuffle.
    """
    op = F.coalesce(field(df, operation, tail), F.lit(""))
    line = "array<struct<value:string,kind:string,broad:array<string>>>"

    def one(value: Column, kind: Column | None = None, broad: Column | None = None) -> Column:
        return F.array(F.struct(value.alias("value"), (F.lit(None) if kind is None else kind).alias("kind"),
                                (F.lit(None) if broad is None else broad).alias("broad"))).cast(line)

    def each(found: Column) -> Column:
        return F.flatten(F.transform(F.array_distinct(F.array_compact(found)), lambda v: one(v)))

    broad = F.array_compact(F.array(*[F.when(in_category(df, c, operation), F.lit(c)) for c in BROAD]))
    columns = [c for c in df.columns if c != tail]
    filled = F.array(*[F.when(is_populated(to_text(df, c)), F.lit(c)) for c in columns])
    nothing = F.array().cast(line)
    found = [("rows", one(F.lit(""))), (_OPERATION, one(op, category_of(op), broad)), (_COLUMN, each(filled)),
             ("tagged", F.when(F.coalesce(field(df, tag, tail), F.lit("")) != "", one(F.lit(""))).otherwise(nothing)),
             *[(n, F.coalesce(each(c), nothing)) for n, c in members.items()],
             *[(f"value:{c}", one(F.coalesce(field(df, c, tail), F.lit("")))) for c in values]]
    if tail in df.columns:
        kept = F.map_keys(F.map_filter(ref(tail), lambda _, v: is_populated(v)))
        found.append((_COLUMN, F.coalesce(each(kept), nothing)))
    lines: dict[str, list[Column]] = {}
    for metric, held in found:
        lines.setdefault(metric, []).append(held)
    # A row for each metric first, then its lines: what asks for one metric works out no other.
    metrics = df.withColumns({"__source": source, "__row": ref(row_id)}).withColumn("__metric", F.explode(F.array(*[F.lit(m) for m in lines])))
    wanted = reduce(lambda case, m: case.when(F.col("__metric") == m, F.concat(*lines[m])), lines, F)
    rows = metrics.select(F.col("__source").alias("source"), "__row", F.col("__metric").alias("metric"), F.explode(wanted).alias("x"))
    return (rows.groupBy("source", "metric", "x.value", "x.kind", "x.broad")
            .agg(F.count(F.lit(1)).alias("n"), F.min("__row").alias("first")))


def without_sources(parts: DataFrame, gone: DataFrame, source: str = "source") -> DataFrame:
    """The parts of the other files."""
    return parts.join(gone.select(ref(source).alias("source")).distinct(), "source", "left_anti")


def merged(parts: DataFrame) -> DataFrame:
    """All parts as one: counts are added."""
    return parts.groupBy("metric", "value", "kind", "broad").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def metrics_of(parts: DataFrame, members: Sequence[str]) -> DataFrame:
    """A3, A10: (metric, value): rows, tagged rows, populated columns and different values of each list."""
    names = ["rows", *members, "tagged", "columns"]
    keys = merged(parts.where(F.col("metric").isin("rows", "tagged", _COLUMN, *members)))
    totals = keys.groupBy("metric").agg(F.count(F.lit(1)).alias("different"), F.sum("n").alias("n"))
    value = F.when(F.col("metric").isin("rows", "tagged"), F.col("n")).otherwise(F.col("different"))
    found = F.map_from_entries(F.collect_list(F.struct(F.when(F.col("metric") == _COLUMN, "columns").otherwise(F.col("metric")), value)))
    return (totals.agg(found.alias("m")).select(F.explode(F.array(*[F.struct(
        F.lit(n).alias("metric"), F.coalesce(F.try_element_at("m", F.lit(n)), F.lit(0)).cast("bigint").alias("value")) for n in names])).alias("x"))
        .select("x.*"))


def _operations(parts: DataFrame) -> DataFrame:
    return merged(parts.where(F.col("metric") == _OPERATION))


def operations_of(parts: DataFrame, top: int = 12) -> DataFrame:
    """A1."""
    name = F.coalesce(F.nullif(F.col("value"), F.lit("")), F.lit(presets.UNKNOWN_OPERATION))
    counts = _operations(parts).groupBy(name.alias("name")).agg(F.sum("n").alias("count"), F.min("first").alias("__first"))
    return counts.orderBy(F.desc("count"), F.asc("__first")).limit(top).drop("__first")


def categories_of(parts: DataFrame) -> DataFrame:
    """A2: rows of every category, zero included."""
    wide = _operations(parts).agg(*[F.coalesce(F.sum(F.when(F.col("kind") == c, F.col("n"))), F.lit(0)).alias(c) for c in CATEGORIES])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("count")) for c in CATEGORIES])).alias("c")).select("c.*")


def facets_of(parts: DataFrame, category: str = "", selected_operation: str = "", top: int = 12) -> DataFrame:
    """A5 of all rows."""
    if category in BROAD:
        chosen = F.array_contains("broad", category)
    else:
        chosen = F.col("kind") == category if category in CATEGORIES else F.lit(True)
    cube = _operations(parts).groupBy("kind", chosen.alias("chosen"), F.col("value").alias("name")).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return facets_of_cube(cube, selected_operation, top=top)


def values_of(parts: DataFrame, column: str) -> DataFrame:
    """The values of a listed column with their counts."""
    return parts.where(F.col("metric") == f"value:{column}").groupBy("value").agg(F.sum("n").alias("count"))


def sources_of(parts: DataFrame) -> DataFrame:
    """Rows and populated columns of each source file."""
    return parts.groupBy("source").agg(F.coalesce(F.sum(F.when(F.col("metric") == "rows", F.col("n"))), F.lit(0)).alias("rowCount"),
                                       F.count_if(F.col("metric") == _COLUMN).alias("columnCount"))
