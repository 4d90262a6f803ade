"""K1-K7: stored tables and exports.  Nothing is collected; Spark writes from its tasks."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import presets
from ..functions.text import TAIL, field, is_populated, ref, to_text
from ..operators.enrich import upsert
from ..operators.facets import populated_columns
from ..operators.shape import clean_table, message_pairs, pairs_from_findings, unique_messages


def _csv(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
     .option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def write_dataset(df: DataFrame, path: str, case_id: str, dataset_id: str) -> None:
    """K1: one dataset of one case; other datasets under the path stay as they are.

    The dataset's columns are noted beside it, so that a reader of the case need not open every file for them.
    """
    def put(rows: DataFrame, folder: str) -> None:
        (rows.withColumns({"case_id": F.lit(case_id), "dataset_id": F.lit(dataset_id)})
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("case_id", "dataset_id").parquet(folder))

    put(df, path)
    put(df.sparkSession.range(1).select(F.lit(df.schema.json()).alias("columns")), f"{path}/{presets.SCHEMA_FOLDER}")


def export_filtered(df: DataFrame, path: str, columns: Sequence[str] | None = None, tail: str = TAIL, *,
                    most_columns: int = 16384) -> list[str]:
    """K2: all rows of a filtered frame with the columns that are populated in it.

    A table has at most ``most_columns``; rows with more different fields go to ``export_cells``.
    """
    names = list(columns or populated_columns(df, tail, most=most_columns))
    _csv(df.select(*[field(df, n, tail).alias(n) for n in names]), path)
    return names


def export_cells(df: DataFrame, row_id: str = "_Row", tail: str = TAIL) -> DataFrame:
    """K2 as a long table (row, column, value) of all populated cells; no field name passes through the driver."""
    own = [c for c in df.columns if c not in (row_id, tail)]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), to_text(df, c).alias("value")) for c in own])
    if tail in df.columns:
        held = F.transform(F.map_entries(ref(tail)), lambda e: F.struct(e["key"].alias("column"), e["value"].alias("value")))
        cells = F.concat(cells, F.coalesce(held, F.array().cast("array<struct<column:string,value:string>>")))
    return df.select(ref(row_id), F.explode(F.filter(cells, lambda c: is_populated(c["value"]))).alias("c")).select(ref(row_id), "c.*")


def export_message_subjects(df: DataFrame, path: str, *, include_size: bool = False, row_id: str = "_Row") -> None:
    """K3: one line per message id of the filtered frame."""
    if "MessageSubject.Pairs" in df.columns:
        pairs = pairs_from_findings(df, row_id=row_id)
    else:
        pairs = message_pairs(df, row_id=row_id)
    _csv(unique_messages(pairs, row_id=row_id, include_size=include_size), path)


def with_bookkeeping(findings: DataFrame, method: str, options: dict | None = None, reference_version: str = "") -> DataFrame:
    """K4: findings with how and when they were made."""
    return findings.withColumns({
        "method": F.lit(method), "options": F.lit(json.dumps(options or {}, default=str, sort_keys=True)),
        "reference_version": F.lit(reference_version), "analyzed_at": F.current_timestamp()})


def write_findings(findings: DataFrame, path: str, method: str, options: dict | None = None,
                   reference_version: str = "") -> None:
    """K4: findings with their bookkeeping.

    New reference rows make login findings stale: they are kept under the version they were made
    with, and ``current_findings`` reads only matching ones.
    """
    with_bookkeeping(findings, method, options, reference_version).write.mode("overwrite").parquet(path)


def findings_summary(stored: DataFrame) -> DataFrame:
    """K4: how many findings each method made with each version of the reference."""
    return stored.groupBy("method", "options", "reference_version").agg(
        F.count(F.lit(1)).alias("findingCount"), F.max("analyzed_at").alias("analyzed_at"))


def current_findings(stored: DataFrame, reference_version: str = "") -> DataFrame:
    """Findings that were made with this version of the reference, without their bookkeeping."""
    return stored.filter(ref("reference_version") == reference_version).drop(
        "method", "options", "reference_version", "analyzed_at")


def write_reference(current: DataFrame | None, fresh: DataFrame, path: str, key: str) -> None:
    """K5: merge lookups into a new folder; the folder that is read is never the one written."""
    merged = fresh if current is None else upsert(current, fresh, key)
    merged.write.mode("errorifexists").parquet(path)


def remember_columns(known: Sequence[str], added: Sequence[str]) -> list[str]:
    """K5: enriched columns in the order they were first used."""
    return list(dict.fromkeys([*known, *added]))


def write_client_table(df: DataFrame, path: str, headers: Sequence[str] | None = None) -> None:
    """K6: the cleaned, shareable table."""
    _csv(clean_table(df, headers), path)


def write_collection_report(report: DataFrame, path: str) -> None:
    """K7."""
    _csv(report.select(*presets.REPORT_FIELDS), path)
