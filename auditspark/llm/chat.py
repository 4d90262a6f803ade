"""Chat formatting with prefix-target expansion, in column functions only.

Every assistant turn becomes an example of its own: all turns before it are the context, and the reply alone is trainable.
Turns after the last reply are one more row without a trainable part, so that no turn is lost.  A template marks the
turns; its control strings inside texts and roles are escaped, reversibly, so that markers can only be markers.

Results in odd cases: a null text or role is empty; rows of a conversation are ordered by turn, equal turns by role and
text, null turns first; rows without a conversation id are one conversation with a null id; a conversation without a reply
has only the row of its remaining turns; repeated rows are repeated turns; an empty table gives an empty table.  As every
example holds its whole context, the formatted text of a conversation must fit into a row.  Columns other than
conversation, turn, role and text are not read, so their names do not matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column


@dataclass(frozen=True)
class Template:
    """``opening`` role ``middle`` text ``closing``, each holding one of the control strings ``controls``.

    A control string starts with a bracket; it is escaped by the mark after that bracket, and one that already has marks
    there gets one more.
    """
    opening: str = "<s>[INST] "
    middle: str = " [/INST] "
    closing: str = " </s>"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")
    mark: str = "~"

    def _patterns(self) -> list[tuple[str, str]]:
        """For each opening bracket: the bracket, and a pattern of what follows in its control strings."""
        brackets = dict.fromkeys(c[0] for c in self.controls)
        return [(b, "|".join(re.escape(c[1:]) for c in self.controls if c[0] == b)) for b in brackets]

    def escape(self, text: Column) -> Column:
        for bracket, rest in self._patterns():
            text = F.regexp_replace(text, f"{re.escape(bracket)}({self.mark}*(?:{rest}))", f"{bracket}{self.mark}$1")
        return text

    def unescape(self, text: Column) -> Column:
        for bracket, rest in self._patterns():
            text = F.regexp_replace(text, f"{re.escape(bracket)}{self.mark}({self.mark}*(?:{rest}))", f"{bracket}$1")
        return text

    def turns(self, text: Column) -> Column:
        """The (role, text) pairs of a formatted text, unescaped."""
        parts = F.split(text, f"\\Q{self.closing}\\E")
        parts = F.slice(parts, 1, F.size(parts) - 1)  # nothing follows the last closing

        def pair(part: Column) -> Column:
            cut = F.split(F.substring(part, len(self.opening) + 1, F.length(part)), f"\\Q{self.middle}\\E", 2)
            return F.struct(self.unescape(cut[0]).alias("role"), self.unescape(cut[1]).alias("text"))

        return F.transform(parts, pair)


def format_prefixes(conversations: DataFrame, template: Template = Template(), *, conv_col: str = "conv_id", turn_col: str = "turn",
                    role_col: str = "role", text_col: str = "text", trainable: str = "assistant") -> DataFrame:
    """One row per reply, and one for the turns after the last: ``conv_id``, ``example`` (from 1), ``text``, ``loss_start`` and
    ``loss_length`` (code points of the trainable part, 0 long for the rest), ``is_last`` (the longest example of the
    conversation) and ``is_rest``.
    """
    text, role = (F.coalesce(column(c).cast("string"), F.lit("")) for c in (text_col, role_col))
    shown = template.escape(text)
    head = F.concat(F.lit(template.opening), template.escape(role), F.lit(template.middle))
    rows = conversations.select(
        column(conv_col).alias("conv_id"),
        F.struct(column(turn_col).alias("turn"), role.alias("role"), text.alias("text"), head.alias("head"), shown.alias("shown")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    whole = grouped.select(
        "conv_id", F.transform("t", lambda t: F.concat(t["head"], t["shown"], F.lit(template.closing))).alias("turns"),
        F.transform("t", lambda t: F.length(t["head"])).alias("heads"), F.transform("t", lambda t: F.length(t["shown"])).alias("lengths"),
        F.filter(F.transform("t", lambda t, i: F.when(t["role"] == trainable, i + 1)), lambda p: p.isNotNull()).alias("replies"))
    last = F.coalesce(F.try_element_at("replies", F.lit(-1)), F.lit(0))
    whole = whole.withColumn("last", last).withColumn(
        "ends", F.when(last < F.size("turns"), F.concat("replies", F.array(F.size("turns")))).otherwise(F.col("replies")))
    each = whole.select("*", F.posexplode("ends").alias("position", "end"))
    rest = F.col("end") > F.col("last")
    context = F.array_join(F.slice("turns", F.lit(1), F.col("end") - 1), "")
    reply = F.element_at("turns", F.col("end"))
    remaining = F.array_join(F.slice("turns", F.col("last") + 1, F.col("end") - F.col("last")), "")
    return each.select(
        "conv_id", (F.col("position") + 1).alias("example"),
        F.when(rest, remaining).otherwise(F.concat(context, reply)).alias("text"),
        F.when(rest, 0).otherwise(F.length(context) + F.element_at("heads", F.col("end"))).cast("long").alias("loss_start"),
        F.when(rest, 0).otherwise(F.element_at("lengths", F.col("end"))).cast("long").alias("loss_length"),
        (F.col("end") == F.col("last")).alias("is_last"), rest.alias("is_rest"))


def read_back(examples: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation what the formatted rows hold: ``turns`` (role, text), ``loss`` (all trainable text, unescaped, in order)
    and ``formatted_chars``."""
    trained = template.unescape(F.expr("substring(text, cast(loss_start + 1 as int), cast(loss_length as int))"))
    longest = F.when(F.col("is_last") | F.col("is_rest"), F.col("text"))
    kept = examples.select("conv_id", F.struct("example", longest.alias("text"), trained.alias("loss")).alias("e"), F.length("text").alias("chars"))
    found = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list("e")).alias("e"), F.sum("chars").alias("formatted_chars"))
    text = F.array_join(F.transform("e", lambda e: e["text"]), "")  # nulls are left out
    return found.select("conv_id", template.turns(text).alias("turns"),
                        F.array_join(F.transform("e", lambda e: e["loss"]), "").alias("loss"), "formatted_chars")
