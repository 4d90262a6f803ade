"""operation categories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import presets
from .text import compact, field

CATEGORIES = [*presets.CATEGORY_OPERATIONS, presets.OTHER_CATEGORY]


def category_of(operation: Column, groups: dict[str, list[str]] | None = None) -> Column:
    """the one category of an operation; the groups are exclusive and ``other`` completes them."""
    key = compact(operation)
    result = F.lit(presets.OTHER_CATEGORY)
    for name, members in reversed((groups or presets.CATEGORY_OPERATIONS).items()):
        result = F.when(key.isin(members), F.lit(name)).otherwise(result)
    return result


def _has_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def is_login(operation: Column) -> Column:
    return _has_any(F.lower(F.coalesce(operation, F.lit(""))), presets.LOGIN_MARKERS)


def in_category(df: DataFrame, category: str, operation: str = "Operation", workload: str = "Workload",
                record_type: str = "RecordType") -> Column:
    """F10 and F11 by name; a blank or unknown name lets every row pass."""
    blank = F.lit("")
    raw_operation = F.coalesce(field(df, operation), blank)
    op, load = F.lower(raw_operation), F.lower(F.coalesce(field(df, workload), blank))
    kind = F.lower(F.coalesce(field(df, record_type), blank))
    name = (category or "").lower()
    if name in CATEGORIES:
        return category_of(raw_operation) == name
    if name == "logins":
        return is_login(raw_operation)
    if name == "teams":
        return (load.contains("teams") | kind.contains("teams")
                | (op.contains("team") & ~load.isin("exchange", "")))
    if name == "files":
        return load.isin(presets.FILE_WORKLOADS) | _has_any(op, presets.FILE_MARKERS)
    if name == "mail":
        return (load == "exchange") & _has_any(op, presets.MAIL_MARKERS)
    return F.lit(True)
