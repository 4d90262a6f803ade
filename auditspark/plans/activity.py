"""Composed flows over audit logs: derive, enrich, hunt, review."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field as dataclass_field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import TAIL
from ..operators.enrich import (distinct_ips, enrich_ip, ip_columns, local_references, map_app_names, pending_lookups,
                                public_addresses)
from ..operators.hunts import (LoginOptions, TravelOptions, impossible_travel, login_address_column,
                               suspicious_logins)
from ..operators.review import activity_narrative, add_narrative, join_findings, mark_tagged
from ..operators.shape import normalize_message_ids, with_inbox_rules, with_login_details, with_mail_details


def derive(rows: DataFrame, apps: DataFrame | None = None, *, row_id: str = "_Row") -> DataFrame:
    """The derivation chain in its fixed order."""
    made = (rows.transform(with_inbox_rules).transform(with_login_details).transform(with_mail_details)
            .transform(normalize_message_ids))
    return made if apps is None else map_app_names(made, apps, row_id=row_id)


@dataclass(frozen=True)
class ReviewData:
    """Tables that a review joins onto its rows; each may be missing."""
    ip_reference: DataFrame | None = None
    enriched_columns: Sequence[str] = dataclass_field(default_factory=tuple)
    travel: DataFrame | None = None
    logins: DataFrame | None = None
    subjects: DataFrame | None = None
    tags: DataFrame | None = None
    narrative_rows: DataFrame | str | None = None


def review(rows: DataFrame, data: ReviewData, *, row_id: str = "_Row") -> DataFrame:
    """Rows as they are reviewed: addresses, findings, tags and narratives in this order.

    The result is one lazy frame that a caller filters further.  Pass only the tables a view needs:
    every one of them is a join.
    """
    view = rows
    for column in data.enriched_columns if data.ip_reference is not None else ():
        view = enrich_ip(view, column, data.ip_reference, row_id=row_id)
    for findings, prefix in ((data.travel, "Travel"), (data.logins, "SuspiciousLogin"),
                             (data.subjects, "MessageSubject")):
        if findings is not None:
            view = join_findings(view, findings, prefix, row_id=row_id)
    if data.tags is not None:
        view = mark_tagged(view, data.tags, row_id=row_id)
    return add_narrative(view, activity_narrative(view), data.narrative_rows, row_id=row_id)


def filtered(view: DataFrame, predicate: Column | None = None, category: Column | None = None,
             operation: Column | None = None) -> DataFrame:
    """Query, category and operation filters together."""
    for test in (predicate, category, operation):
        if test is not None:
            view = view.filter(F.coalesce(test, F.lit(False)))
    return view


@dataclass(frozen=True)
class LookupPlan:
    """What an external lookup has to fetch, and the rows that need none."""
    pending: DataFrame
    local: DataFrame


def plan_lookups(rows: DataFrame, reference: DataFrame, columns: Sequence[str] = (), *,
                 providers: Sequence[str] | None = None, reference_key: str = "ip") -> LookupPlan:
    """Addresses of the filtered rows that have no usable reference row."""
    chosen = list(columns) or None
    if not (chosen or TAIL in rows.columns or ip_columns(rows.columns)):
        raise ValueError("No IP column was detected; choose an IP column")
    pending = pending_lookups(distinct_ips(rows, chosen, reference_key), reference, reference_key, providers=providers)
    return LookupPlan(public_addresses(pending, reference_key), local_references(pending, reference_key))


def hunt_travel(rows: DataFrame, reference: DataFrame, enriched: Sequence[str],
                options: TravelOptions = TravelOptions(), **names) -> DataFrame:
    """H1 over a whole dataset."""
    return impossible_travel(rows, reference, options, address=login_address_column(enriched), **names)


def hunt_logins(rows: DataFrame, reference: DataFrame, enriched: Sequence[str],
                options: LoginOptions = LoginOptions(), **names) -> DataFrame:
    """H2 over a whole dataset."""
    return suspicious_logins(rows, reference, options, address=login_address_column(enriched), **names)
