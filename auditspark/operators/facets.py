"""Counts, facets and metrics.  Every aggregate combines before its shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import presets
from ..functions.categories import CATEGORIES, category_of, in_category
from ..functions.mail import split_list
from ..functions.network import normalize_ip
from ..functions.text import TAIL, field, first_populated, is_populated, non_blank, ref, text_of, to_text
from .enrich import addresses_of, trace_ip_columns


def operation_counts(df: DataFrame, operation: str = "Operation", *, row_id: str = "_Row", top: int = 12) -> DataFrame:
    """A1: most frequent operations; blank counts as Unknown, ties by first appearance."""
    name = F.coalesce(F.nullif(field(df, operation), F.lit("")), F.lit(presets.UNKNOWN_OPERATION))
    counts = df.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("count"), F.min(ref(row_id)).alias("__first"))
    return counts.orderBy(F.desc("count"), F.asc("__first")).limit(top).drop("__first")


def category_counts(df: DataFrame, operation: str = "Operation", *,
                    groups: dict[str, list[str]] | None = None) -> DataFrame:
    """A2: rows of every category, zero included; categories are exclusive and complete."""
    kind = category_of(field(df, operation), groups)
    names = list(groups) + [presets.OTHER_CATEGORY] if groups else CATEGORIES
    wide = df.agg(*[F.count_if(kind == n).alias(n) for n in names])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("category"), F.col(n).alias("count"))
                                           for n in names])).alias("c")).select("c.*")


def faceted_counts(queried: DataFrame, category: str = "", selected_operation: str = "", *,
                   operation: str = "Operation", row_id: str = "_Row", top: int = 12, shares: int = 64) -> DataFrame:
    """A5: (facet, name, count) of a queried frame.

    ``all`` and ``category`` count the query alone, ``operationTotal`` and ``operation`` the query
    within the category.  One pass builds a small cube; every facet is read from the cube.
    Rows with a blank operation take no part in the operation facet.
    """
    op = F.coalesce(field(queried, operation), F.lit(""))
    cube = queried.groupBy(category_of(op).alias("kind"), in_category(queried, category, operation).alias("chosen"),
                           op.alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min(ref(row_id)).alias("first"))
    return facets_of_cube(cube, selected_operation, top=top, shares=shares)


def facets_of_cube(cube: DataFrame, selected_operation: str = "", *, top: int = 12, shares: int = 64) -> DataFrame:
    """A5 from counts (kind, chosen, name, n, first)."""
    def line(facet: str, name: Column, n: Column, first: Column) -> Column:
        return F.struct(F.lit(facet).alias("facet"), name.alias("name"), n.alias("n"), first.alias("first"))

    def of_cube(facet: str, name: Column, counts: Column | None = None) -> Column:
        made = line(facet, name, F.col("n"), F.col("first"))
        return made if counts is None else F.when(counts, made)

    lines = cube.select(F.explode(F.array_compact(F.array(
        of_cube("all", F.lit("")), of_cube("category", F.col("kind")),
        of_cube("operationTotal", F.lit(""), F.col("chosen")),
        of_cube("operation", F.col("name"), F.col("chosen") & (F.col("name") != ""))))).alias("x")).select("x.*")
    # Facets without a single row are reported as well.
    nothing = (F.lit(0).cast("bigint"), F.lit(None).cast(cube.schema["first"].dataType))
    empty = cube.sparkSession.range(1).select(F.explode(F.array(
        line("all", F.lit(""), *nothing), line("operationTotal", F.lit(""), *nothing),
        *[line("category", F.lit(c), *nothing) for c in CATEGORIES])).alias("x")).select("x.*")
    counted = lines.unionByName(empty).groupBy("facet", "name").agg(
        F.sum("n").cast("bigint").alias("count"), F.min("first").alias("first"))
    # Leading operations of every share first, then of all, so that no task ranks all operations.
    order = [F.desc("count"), F.asc("first")]
    wanted = (F.col("facet") != "operation") | (F.col("place") <= top) | (F.col("name") == selected_operation)
    ranked = counted.withColumn("share", F.pmod(F.xxhash64("name"), F.lit(shares)))
    for group in (["facet", "share"], ["facet"]):
        place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        ranked = ranked.withColumn("place", place).filter(wanted)
    return ranked.select("facet", "name", "count")


def _value_counts(df: DataFrame, column: str, tail: str) -> DataFrame:
    return df.groupBy(F.coalesce(field(df, column, tail), F.lit("")).alias("value")).agg(
        F.count(F.lit(1)).alias("count"))


def value_facets(df: DataFrame, column: str, search: str = "", offset: int = 0, limit: int = 200,
                 tail: str = TAIL) -> DataFrame:
    """Values with their counts, most frequent first, then by folded text; one page of them."""
    counts = _value_counts(df, column, tail)
    if search:
        counts = counts.filter(F.lower("value").contains(search.lower()))
    page = counts.orderBy(F.desc("count"), F.lower("value"), F.col("value"))
    label = F.coalesce(F.nullif(F.col("value"), F.lit("")), F.lit(presets.EMPTY_LABEL))
    return (page.offset(max(0, int(offset))).limit(min(500, max(1, int(limit))))
            .select("value", label.alias("label"), "count"))


def value_facets_after(df: DataFrame, column: str, last: tuple[int, str] | None, search: str = "", limit: int = 200, tail: str = TAIL) -> DataFrame:
    """A6 for deep pages: the values that follow ``last``, the count and value of the last line seen (None: the first page).

    No page skips lines before it, so each costs a bounded top-k however deep it lies.
    """
    counts = _value_counts(df, column, tail)
    if search:
        counts = counts.filter(F.lower("value").contains(search.lower()))
    if last is not None:
        count, value = F.lit(last[0]), F.lit(last[1])
        folded = F.struct(F.lower("value"), F.col("value")) > F.struct(F.lower(value), value)
        counts = counts.filter((F.col("count") < count) | ((F.col("count") == count) & folded))
    label = F.coalesce(F.nullif(F.col("value"), F.lit("")), F.lit(presets.EMPTY_LABEL))
    return (counts.orderBy(F.desc("count"), F.lower("value"), F.col("value")).limit(min(500, max(1, int(limit))))
            .select("value", label.alias("label"), "count"))


def value_facet_totals(df: DataFrame, column: str, search: str = "", offset: int = 0, limit: int = 200,
                       tail: str = TAIL) -> DataFrame:
    """Distinct values in all and matching the search, and whether a page leaves more."""
    end = max(0, int(offset)) + min(500, max(1, int(limit)))
    return (_value_counts(df, column, tail)
            .agg(F.count(F.lit(1)).alias("totalUnique"),
                 F.count_if(F.lower("value").contains(search.lower())).alias("matchingUnique"),
                 F.sum("count").alias("matchingRows"))
            .withColumn("hasMore", F.col("matchingUnique") > end))


def populated_profile(df: DataFrame, columns: Sequence[str] | None = None, tail: str = TAIL) -> DataFrame:
    """(column, populated rows) of every typed column in one aggregate, and of every tail key."""
    names = [c for c in (columns or df.columns) if c != tail]
    wide = df.agg(*[F.count_if(is_populated(to_text(df, c))).alias(f"n{i}") for i, c in enumerate(names)])
    lines = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("populated")) for i, c in enumerate(names)
    ])).alias("x")).select("x.*")
    if tail in df.columns and columns is None:
        kept = F.map_filter(ref(tail), lambda _, v: is_populated(v))
        keys = df.select(F.explode(F.map_keys(kept)).alias("column")).groupBy("column").agg(
            F.count(F.lit(1)).alias("populated"))
        lines = lines.unionByName(keys)
    return lines


def populated_columns(df: DataFrame, tail: str = TAIL, most: int = 16384) -> list[str]:
    """R18 as names: priority order, then sorted.  Collects one short row per column, and refuses more than ``most``."""
    listed = populated_profile(df, tail=tail).filter("populated > 0").select("column").distinct()
    found = {r["column"] for r in listed.limit(most + 1).collect()}
    if len(found) > most:
        raise ValueError(f"More than {most} columns are populated; choose columns or export cells")
    first = [c for c in presets.COLUMN_PRIORITY if c in found]
    return first + sorted(found - set(first))


def _distinct_metrics(df: DataFrame, members: dict[str, Column], tagged: Column) -> DataFrame:
    """(metric, value): row counts and exact distinct counts of several value lists in one pass.

    Every row yields its values as (metric, text) pairs; equal pairs collapse before the shuffle.
    """
    pairs = F.concat(F.array(F.struct(F.lit("rows").alias("metric"), F.lit("").alias("v"))),
                     F.when(tagged, F.array(F.struct(F.lit("tagged").alias("metric"), F.lit("").alias("v"))))
                     .otherwise(F.array().cast("array<struct<metric:string,v:string>>")),
                     *[_as_pairs(name, values) for name, values in members.items()])
    counted = df.select(F.explode(pairs).alias("p")).groupBy("p.metric", "p.v").agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy("metric").agg(F.count(F.lit(1)).alias("different"), F.sum("n").alias("n"))
    value = F.when(F.col("metric").isin("rows", "tagged"), F.col("n")).otherwise(F.col("different"))
    present = F.map_from_entries(F.collect_list(F.struct("metric", value.alias("value"))))
    names = ["rows", *members, "tagged"]
    return (totals.agg(present.alias("m")).select(F.explode(F.array(*[F.struct(
        F.lit(n).alias("metric"), F.coalesce(F.try_element_at("m", F.lit(n)), F.lit(0)).cast("bigint").alias("value"))
        for n in names])).alias("x")).select("x.*"))


def _as_pairs(name: str, values: Column) -> Column:
    return F.transform(F.array_compact(values), lambda v: F.struct(F.lit(name).alias("metric"), v.alias("v")))


def _column_total(df: DataFrame, tail: str) -> DataFrame:
    return (populated_profile(df, tail=tail).filter("populated > 0")
            .agg(F.count_distinct("column").alias("value"))
            .select(F.lit("columns").alias("metric"), "value"))


def identity(df: DataFrame, names: Sequence[str] | None = None) -> Column:
    """A4: the first populated user field, folded."""
    return F.lower(first_populated(df, list(names or presets.FIELD_ALIASES["user"])))


def review_metrics(df: DataFrame, *, user_fields: Sequence[str] | None = None,
                   address_columns: Sequence[str] | None = None, message_ids: str = "InternetMessageIDs",
                   tag: str = "Review.Tag", tail: str = TAIL) -> DataFrame:
    """A3, A4: rows, populated columns, distinct users, addresses and message ids, tagged rows."""
    members = {
        "users": F.array(identity(df, user_fields)),
        "ips": addresses_of(df, address_columns, tail),
        "messageIds": split_list(field(df, message_ids, tail)),
    }
    tagged = F.coalesce(field(df, tag, tail), F.lit("")) != ""
    return _distinct_metrics(df, members, tagged).unionByName(_column_total(df, tail))


def trace_metrics(df: DataFrame, *, sender: str = "SenderAddress", recipient: str = "RecipientAddress",
                  address_columns: Sequence[str] | None = None, tag: str = "Review.Tag",
                  tail: str = TAIL) -> DataFrame:
    """A10."""
    addresses = list(address_columns if address_columns is not None else trace_ip_columns(df.columns))
    members = {
        "senders": F.array(F.nullif(F.lower(field(df, sender, tail)), F.lit(""))),
        "recipients": F.array(F.nullif(F.lower(field(df, recipient, tail)), F.lit(""))),
        "ips": (F.array(*[normalize_ip(text_of(df, c)) for c in addresses]) if addresses
                else F.array().cast("array<string>")),
    }
    tagged = F.coalesce(field(df, tag, tail), F.lit("")) != ""
    return _distinct_metrics(df, members, tagged).unionByName(_column_total(df, tail))


def distinct_message_ids(df: DataFrame, column: str = "InternetMessageIDs", name: str = "message_id") -> DataFrame:
    """A8."""
    return df.select(F.explode(split_list(field(df, column))).alias(name)).distinct().orderBy(name)


def app_totals(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with a mapped application, known and unlisted values."""
    names = list(columns or [c for c in df.columns if c.startswith("AppMapping.")])
    values = F.array(*[non_blank(text_of(df, c)) for c in names]) if names else F.array().cast("array<string>")
    mapped = F.array_compact(values)
    unlisted = F.size(F.filter(mapped, lambda v: v == presets.UNLISTED_APP))
    return df.agg(F.count_if(F.size(mapped) > 0).alias("mappedRows"),
                  F.coalesce(F.sum(F.size(mapped) - unlisted), F.lit(0)).alias("known"),
                  F.coalesce(F.sum(unlisted), F.lit(0)).alias("unlisted"))


def hunt_totals(findings: DataFrame) -> DataFrame:
    """Findings of a mail hunt and how many carry each kind of signal."""
    def filled(name: str) -> Column:
        return F.count_if(is_populated(ref(name)))
    return findings.agg(F.count(F.lit(1)).alias("findingCount"), filled("NewDomains").alias("domainHitCount"),
                        filled("SubjectKeywords").alias("subjectHitCount"),
                        filled("ServiceDomains").alias("serviceHitCount"))


def parse_errors(df: DataFrame, column: str = "_ParseError") -> DataFrame:
    """A18."""
    return df.agg(F.count_if(F.coalesce(field(df, column), F.lit("")) != "").alias("parseErrors"))


def case_rollup(datasets: DataFrame, case_id: str = "caseId", rows: str = "rowCount") -> DataFrame:
    """Rows and datasets of every case."""
    return datasets.groupBy(ref(case_id)).agg(F.sum(ref(rows)).cast("bigint").alias("rowCount"),
                                              F.count(F.lit(1)).alias("datasetCount"))
