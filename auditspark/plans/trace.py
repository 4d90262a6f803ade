"""Composed flows over mail traces."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field as dataclass_field

from pyspark.sql import DataFrame

from ..operators.enrich import distinct_domains, enrich_domains, enrich_ip, pending_lookups
from ..operators.review import add_narrative, join_findings, mark_tagged, trace_narrative


@dataclass(frozen=True)
class TraceData:
    """Tables that a trace review joins onto its rows; each may be missing."""
    ip_reference: DataFrame | None = None
    ip_columns: Sequence[str] = dataclass_field(default_factory=tuple)
    domain_reference: DataFrame | None = None
    domain_columns: Sequence[str] = dataclass_field(default_factory=tuple)
    hunt: DataFrame | None = None
    tags: DataFrame | None = None
    narrative_rows: DataFrame | str | None = None


def review(rows: DataFrame, data: TraceData, *, row_id: str = "_Row") -> DataFrame:
    """Trace rows as they are reviewed."""
    view = rows
    for column in data.ip_columns if data.ip_reference is not None else ():
        view = enrich_ip(view, column, data.ip_reference, row_id=row_id)
    for column in data.domain_columns if data.domain_reference is not None else ():
        view = enrich_domains(view, column, data.domain_reference, row_id=row_id)
    if data.hunt is not None:
        view = join_findings(view, data.hunt, "MessageTraceHunt", row_id=row_id)
    if data.tags is not None:
        view = mark_tagged(view, data.tags, row_id=row_id)
    return add_narrative(view, trace_narrative(view), data.narrative_rows, row_id=row_id)


def pending_domains(rows: DataFrame, reference: DataFrame, columns: Sequence[str] = (),
                    reference_key: str = "Domain") -> DataFrame:
    """Domains of the filtered rows without a usable reference row."""
    chosen = list(columns) or [c for c in ("SenderAddress", "RecipientAddress") if c in rows.columns]
    if not chosen:
        raise ValueError("No SenderAddress or RecipientAddress column was detected")
    return pending_lookups(distinct_domains(rows, chosen, reference_key), reference, reference_key)
