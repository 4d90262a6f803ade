"""Findings, tags and narratives on records.

Tags and narrative selections are one-column tables of row ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import presets
from ..functions.categories import in_category
from ..functions.network import normalize_ip
from ..functions.text import TAIL, field, first_text, let, ref, text_of, truthy, typed_column


def join_findings(df: DataFrame, findings: DataFrame, prefix: str, *, row_id: str = "_Row") -> DataFrame:
    """Finding fields as ``{prefix}.{field}``."""
    named = findings.select(ref(row_id).alias(row_id), *[
        ref(c).alias(f"{prefix}.{c}") for c in findings.columns if c != row_id])
    return df.join(named, row_id, "left")


def mark_tagged(df: DataFrame, tags: DataFrame, *, row_id: str = "_Row", name: str = "Review.Tag") -> DataFrame:
    """J5."""
    marked = tags.select(ref(row_id)).distinct().withColumn(name, F.lit(presets.TAG_TEXT))
    return df.join(marked, row_id, "left")


def existing_ids(requested: DataFrame, df: DataFrame, *, row_id: str = "_Row") -> DataFrame:
    """Requested row ids that exist, each once."""
    return requested.select(ref(row_id)).distinct().join(df.select(ref(row_id)), row_id, "left_semi")


def add_ids(current: DataFrame, requested: DataFrame, *, row_id: str = "_Row") -> DataFrame:
    """Tag, or select for a narrative."""
    return current.select(ref(row_id)).union(requested.select(ref(row_id))).distinct()


def remove_ids(current: DataFrame, requested: DataFrame, *, row_id: str = "_Row") -> DataFrame:
    """Untag."""
    return current.select(ref(row_id)).join(requested.select(ref(row_id)), row_id, "left_anti")


def change_tags(df: DataFrame, tags: DataFrame, requested: DataFrame, tagged: bool, *,
                row_id: str = "_Row") -> DataFrame:
    """The tag table after tagging or untagging existing rows."""
    rows = existing_ids(requested, df, row_id=row_id)
    return add_ids(tags, rows, row_id=row_id) if tagged else remove_ids(tags, rows, row_id=row_id)


def tag_change(df: DataFrame, tags: DataFrame, requested: DataFrame, tagged: bool, *,
               row_id: str = "_Row") -> DataFrame:
    """Rows matched, rows changed, rows tagged afterwards, from one full outer join of id sets."""
    rows = existing_ids(requested, df, row_id=row_id).withColumn("__asked", F.lit(True))
    both = tags.select(ref(row_id)).distinct().withColumn("__had", F.lit(True)).join(rows, row_id, "full")
    asked, had = F.col("__asked").isNotNull(), F.col("__had").isNotNull()
    changed = asked & (~had if tagged else had)
    after = (had | asked) if tagged else (had & ~asked)
    return both.agg(F.count_if(asked).alias("matched"), F.count_if(changed).alias("changed"),
                    F.count_if(after).alias("taggedCount"))


def add_narrative(df: DataFrame, narrative: Column, selection: DataFrame | str | None, *, row_id: str = "_Row",
                  name: str = "Event") -> DataFrame:
    """``selection`` is None (no narrative), ``"all"``, or a table of row ids."""
    if selection is None:
        return df
    if isinstance(selection, str):
        return df.withColumn(name, narrative)
    chosen = selection.select(ref(row_id)).distinct().withColumn("__chosen", F.lit(True))
    return (df.withColumn(name, narrative).join(chosen, row_id, "left")
            .withColumn(name, F.when(F.col("__chosen"), F.col(name))).drop("__chosen"))


def _clause(label: str, value: Column) -> Column:
    """NULL without a value, so that joining skips it."""
    return F.concat(F.lit(label), value)


def ip_context(df: DataFrame) -> Column:
    """The address a narrative speaks of and what is known about it, as struct of ip and text.

    The first address column that has joined attributes, else the first that holds an address.
    """
    known, plain = [], []
    for column in presets.CONTEXT_IP_COLUMNS:
        if typed_column(df, column) is None and TAIL not in df.columns:
            continue
        address = normalize_ip(field(df, column))

        def value(suffix: str, column: str = column) -> Column:
            return first_text(df, [f"{column}_IPAPI_{suffix}"])

        held = [s for s in ("Country", "Region", "City", "ISP", "Proxy_VPN_TOR", "Hosting")
                if any(c.lower() == f"{column}_IPAPI_{s}".lower() for c in df.columns)]
        place = F.nullif(F.concat_ws(", ", value("Country"), value("Region"), value("City")), F.lit(""))
        context = F.concat_ws("; ", _clause("geo-location ", place), _clause("ISP ", value("ISP")),
                              F.when(truthy(value("Proxy_VPN_TOR")), F.lit("VPN/Proxy/TOR")),
                              F.when(truthy(value("Hosting")), F.lit("Hosting")))
        plain.append(address)
        if held:
            informed = F.coalesce(*[value(s) for s in held]).isNotNull()
            known.append(F.when(informed, F.struct(address.alias("ip"), context.alias("text"))))
    bare = [F.struct(ip.alias("ip"), F.lit("").alias("text")) for ip in plain]
    if not bare:
        return F.struct(F.lit(None).cast("string").alias("ip"), F.lit("").alias("text"))
    return F.get(F.filter(F.array(*known, *bare), lambda x: x["ip"].isNotNull()), 0)


def activity_narrative(df: DataFrame, operation: str = "Operation") -> Column:
    """``Operation: clause; clause.`` by kind of activity."""
    def value(*names: str) -> Column:
        return first_text(df, list(names))

    user = value("UserId", "MailboxOwnerUPN", "Actor.UserId", "Sender", "UserKey")
    place = let(ip_context(df), lambda at: F.concat_ws(
        "; ", _clause("from IP ", at["ip"]), F.nullif(at["text"], F.lit(""))))
    logins, rules, teams, files, mail = [in_category(df, c, operation) for c in (
        "logins", "inbox_rules", "teams", "files", "mail")]
    source, target = value("SourceFileName", "ItemName", "ObjectId"), value("DestinationFileName")
    mailbox = value("MailboxOwnerUPN")
    by_kind = (
        F.when(logins, F.lit(None).cast("string"))
        .when(rules, F.concat_ws("; ", _clause("rule ", value("InboxRule.Name")),
                                 _clause("actions ", value("InboxRule.Details"))))
        .when(teams, F.concat_ws("; ", _clause("team ", value("TeamName")), _clause("channel ", value("ChannelName")),
                                 _clause("chat ", value("ChatThreadId")), _clause("meeting ", value("MeetingId"))))
        .when(files, F.concat_ws(
            "; ", _clause("item ", source),
            F.when(~F.coalesce(target == source, F.lit(False)), _clause("destination ", target)),
            _clause("path ", value("FolderPathName", "SourceRelativeUrl")), _clause("site ", value("SiteUrl")),
            _clause("external access ", value("ExternalAccess"))))
        .when(mail, F.concat_ws(
            "; ", F.when(F.lower(mailbox) != F.lower(F.coalesce(user, F.lit(""))), _clause("mailbox ", mailbox)),
            _clause("subject ", value("MessageSubject.Subjects", "Item.Subject", "Subject")),
            _clause("message ID ", value("MessageSubject.InternetMessageIDs", "InternetMessageIDs",
                                         "InternetMessageId", "Item.InternetMessageId")),
            _clause("folder/item ", value("FolderPathName", "ItemName"))))
        .otherwise(_clause("object ", value("ObjectId", "ItemName"))))
    result = value("ResultStatus", "Result", "Login.ResultStatusDetail", "LogonError")
    clauses = F.concat_ws(
        "; ", user, F.nullif(place, F.lit("")),
        F.nullif(by_kind, F.lit("")), F.when(~logins, _clause("workload ", value("Workload"))),
        F.when(~logins, _clause("result ", result)))
    return F.concat(F.coalesce(value(operation), F.lit("Audit event")), F.lit(": "), F.coalesce(
        F.nullif(clauses, F.lit("")), F.lit("No additional populated context")), F.lit("."))


def trace_narrative(df: DataFrame) -> Column:
    """R26."""
    def value(*names: str) -> Column:
        return F.coalesce(first_text(df, list(names)), F.lit(""))
    return F.concat(
        F.lit("Subject: "), value("message_subject", "Subject", "MessageSubject", "Message Subject"),
        F.lit("; Sender: "), value("SenderAddress", "Sender"),
        F.lit("; Recipient: "), value("RecipientAddress", "Recipient"))


def tagged_only(df: DataFrame, name: str = "Review.Tag") -> DataFrame:
    """F15."""
    return df.filter(F.coalesce(text_of(df, name), F.lit("")) != "")
