"""Mail texts: message ids, address domains, user agents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import presets
from .text import WHITESPACE, strip

# A local part starts where its run of characters starts or right after the last match, so a
# long run without an @ is read once rather than once per character.
_ADDRESS = (rf"(?i)(?:\G|(?<![{presets.EMAIL_LOCAL_CLASS}]))[{presets.EMAIL_LOCAL_CLASS}]++@([A-Z0-9.-]+)")


def quoted_member(name: str) -> str:
    """Pattern of a member of a quoted record up to the opening quote of its value."""
    return rf"""["']?{name}["']?\s*+:\s*+["']"""


# An id in angle brackets as the value of such a member.
_ID_MEMBER = rf"(?i){quoted_member('internetmessageid')}<([^<>]++)>"
# What follows the name of the agent and its separator in a list with semicolons.
_AGENT = r"(?is)(?:^|;)\s*+useragent\s*+[=:-](.*)"
_DOMAIN = rf"^{presets.DOMAIN_LABEL}(?:\.{presets.DOMAIN_LABEL})+$"


def format_message_id(c: Column) -> Column:
    """Bare or wrapped id -> wrapped id; blank stays blank."""
    bare = F.btrim(strip(F.coalesce(c, F.lit(""))), F.lit("<>"))
    return F.when(bare == "", F.lit("")).otherwise(F.concat(F.lit("<"), bare, F.lit(">")))


def split_list(c: Column, separator: str = ";") -> Column:
    """Non-blank, stripped parts of a separated text."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), separator, -1), strip)
    return F.filter(parts, lambda p: p != "")


def wrap_id_list(c: Column) -> Column:
    """R6 for one ``;`` list."""
    return F.array_join(F.transform(split_list(c), format_message_id), "; ")


def ids_in_text(c: Column) -> Column:
    """What stands between blanks and angle brackets, where an ``@`` has something on both sides."""
    parts = F.split(F.coalesce(c, F.lit("")), r"[<>\s]+", -1)
    named = F.filter(parts, lambda p: F.substring(p, F.lit(2), F.greatest(F.length(p) - 2, F.lit(0))).contains("@"))
    return F.transform(named, format_message_id)


def ids_in_payload(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(_ID_MEMBER), F.lit(1)), format_message_id)


def clean_domain(c: Column) -> Column:
    """Lower case without outer dots, or NULL when it is no domain of two labels or more."""
    text = F.btrim(F.lower(c), F.lit("." + WHITESPACE))
    return F.when((F.length(text) <= 253) & text.rlike(_DOMAIN), text)


def email_domains(c: Column) -> Column:
    """Domains of all addresses in a text, each once, in order of appearance."""
    found = F.transform(F.regexp_extract_all(c, F.lit(_ADDRESS), F.lit(1)), clean_domain)
    return F.when(c.contains("@"), F.array_distinct(F.array_compact(found))).otherwise(
        F.array().cast("array<string>"))


def actor_user_agent(c: Column) -> Column:
    """The part after ``UserAgent=`` of an actor string; blank when there is none."""
    return strip(F.regexp_extract(F.coalesce(c, F.lit("")), _AGENT, 1))


def parent_domains(c: Column) -> Column:
    """The domain itself and every parent, longest first."""
    labels = F.split(c, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)),
                       lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
