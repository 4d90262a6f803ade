"""S1, S2 for large files: one file is read by many tasks.

Spark's text source cuts a file into byte blocks at any separator, so a file is read as small *chunks*: a JSON document up
to each ``}``, a CSV file up to each line end.  What a chunk means depends on all before it (is it within a string, how deep
do its brackets stand), but only through a small state; what each chunk does to the state is known from the chunk alone,
and running sums over ranges of chunks give the state where each begins.  Chunks are then put together to records.  No task
holds more than a range of chunks, or one record.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WHITESPACE, ref
from ..operators.ordering import Borders, Key, sample_borders, with_running

_ORDER = ["__block", "__at"]
_PLACE = "struct<__block:bigint,__at:bigint>"
_OPEN = r'(?s)^(.*?)(?<!\\)"%s"\s*:'


def chunks_of(spark: SparkSession, path: str | Sequence[str], separator: str) -> DataFrame:
    """(__path, __size, __block, __at, chunk): the texts between separators; block and place give their order in the file."""
    raw = spark.read.option("lineSep", separator).text(path)
    return raw.select(F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_size").alias("__size"),
                      F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"),
                      F.col("value").alias("chunk"))


def _keys() -> list[Key]:
    return [Key(F.col(c)) for c in _ORDER]


def _borders(chunks: DataFrame, ranges: int | None) -> Borders:
    """Where the ranges of chunks begin; every pass over them uses the same."""
    return sample_borders(chunks, [Key(F.col("__path")), *_keys()], ranges)


def _running(df: DataFrame, borders: Borders, **values: Column) -> DataFrame:
    return with_running(df, _keys(), values, ["__path"], borders=borders)


# --- JSON ----------------------------------------------------------------------------------------

def _plain_parts(text: Column) -> Column:
    """A text between its quotes; escapes are out of the way."""
    return F.split(F.regexp_replace(text, r"(?s)\\.", ""), '"', -1)


def _brackets(parts: Column, quoted: int) -> Column:
    """The brackets outside strings, for a text that begins outside (0) or within (1) one."""
    outside = F.filter(parts, lambda _, i: i % 2 == quoted)
    return F.regexp_replace(F.array_join(outside, ""), r"[^\[\]{}]", "")


def _depth(brackets: Column) -> Column:
    """(least, last): the lowest depth that the brackets reach, from 0, and the depth behind them."""
    each = F.filter(F.split(brackets, ""), lambda c: c != "")
    zero = F.struct(F.lit(0).alias("least"), F.lit(0).alias("last"))

    def add(state: Column, c: Column) -> Column:
        now = state["last"] + F.when(c.isin("[", "{"), 1).otherwise(-1)
        return F.struct(F.least(state["least"], now).alias("least"), now.alias("last"))

    return F.aggregate(each, zero, add)


def json_elements(spark: SparkSession, path: str | Sequence[str], ranges: int | None = None) -> DataFrame:
    """(__path, __group, __pos, __record): the elements of JSON documents as texts, in order of (group, pos).

    A document is an array, an object whose ``value`` or ``records`` member is an array (``value`` goes first), or any other
    object, which is its own only element.  Other and broken documents fail the job with the file's name.
    """
    chunks = chunks_of(spark, path, "}")
    borders = _borders(chunks, ranges)
    parts = _plain_parts(F.col("chunk"))
    quotes = (F.size(parts) - 1) % 2
    quoted = _running(chunks.withColumns({"__parts": parts, "__flips": quotes}), borders, __upto=F.col("__flips"))
    quoted = quoted.withColumn("__in", ((F.col("__upto") - F.col("__flips")) % 2).cast("int"))
    walked = quoted.withColumn("__walk", _depth(F.when(F.col("__in") == 0, _brackets(F.col("__parts"), 0)).otherwise(_brackets(F.col("__parts"), 1))))
    closes = (F.col("__upto") % 2 == 0).cast("int")  # the chunk's own brace is outside strings
    stepped = walked.withColumns({"__closes": closes, "__step": F.col("__walk.last") - closes})
    deep = _running(stepped.drop("__parts"), borders, __deep=F.col("__step"))
    deep = deep.withColumn("__from", F.col("__deep") - F.col("__step"))

    def found(name: str) -> Column:
        """Whether the member begins in this chunk."""
        before = F.regexp_extract("chunk", _OPEN % name, 1)
        level = F.col("__from") + _depth(F.when(F.col("__in") == 0, _brackets(_plain_parts(before), 0)).otherwise(
            _brackets(_plain_parts(before), 1)))["last"]
        return F.col("chunk").rlike(_OPEN % name) & (level == 1)

    place = F.struct(*_ORDER)
    start = F.ltrim(F.regexp_replace("chunk", f"^[{WHITESPACE}﻿]+", ""))
    marked = deep.withColumns({"__value": found("value"), "__records": found("records")})
    # One row for each file: what it is, where its elements begin, and whether it ends as it should.
    files = marked.groupBy("__path").agg(
        F.min_by(start, place).substr(1, 1).alias("__kind"), F.min(place).alias("__first"),
        F.min(F.when(F.col("__value"), place)).alias("__at_value"), F.min(F.when(F.col("__records"), place)).alias("__at_records"),
        F.max("__size").alias("__whole"), F.sum(F.octet_length("chunk") + 1).alias("__seen"), F.max_by(F.struct("__deep", "__upto", "__closes", "chunk"), place).alias("__end"))
    ended = (F.col("__whole") - F.col("__seen")).isin(0, 3)  # else the last chunk has no brace behind it (a byte-order mark: 3 bytes)
    final = F.col("__end.__deep") + F.when(ended, 0).otherwise(F.col("__end.__closes"))
    array = F.col("__kind") == "["
    member = F.when(array, "[").when(F.col("__at_value").isNotNull(), "value").when(F.col("__at_records").isNotNull(), "records").otherwise("{")
    closed = ~array | F.col("__end.chunk").rlike(f"\\][{WHITESPACE}]*$")

    def fail(what: str) -> Column:
        return F.raise_error(F.concat(F.lit(f"{what}: "), F.col("__file")))

    begin = F.coalesce("__at_value", "__at_records", "__first")
    files = files.where(F.col("__kind") != "").select(
        F.col("__path").alias("__file"), member.alias("__member"), "__kind", F.when(array, F.col("__first")).otherwise(begin).alias("__begin"),
        ((final == 0) & (F.col("__end.__upto") % 2 == 0) & closed).alias("__sound"))
    known = files.select("__file", "__member", F.when(F.col("__member") == "[", 1).when(F.col("__member") == "{", 0).otherwise(2).alias("__base"),
                         F.when(~F.col("__kind").isin("[", "{"), fail("JSON input must be an array or contain a value/records array").cast(_PLACE))
                         .when(~F.col("__sound"), fail("Invalid JSON document").cast(_PLACE)).otherwise(F.col("__begin")).alias("__begin"))
    inside = marked.join(known, (F.col("__path") == F.col("__file")) & (place >= F.col("__begin")))
    first = place == F.col("__begin")
    behind = F.regexp_replace("chunk", F.when(F.col("__member") == "[", F.lit(r"(?s)^[^\[]*\[")).when(
        F.col("__member") == "{", F.lit(r"(?s)^[^{]*")).otherwise(
        F.concat(F.lit(r'(?s)^.*?(?<!\\)"'), F.col("__member"), F.lit(r'"\s*:\s*'))), F.lit(""))
    opened = F.when(F.col("__member").isin("[", "{"), behind).when(behind.startswith("["), behind.substr(F.lit(2), F.length(behind))).otherwise(
        fail("JSON input must be an array or contain a value/records array").cast("string"))
    below = F.col("__from") + F.col("__walk.least") < F.col("__base")  # the elements end in this chunk
    ends = (F.col("__deep") == F.col("__base")) & (F.col("__closes") == 1)
    counted = _running(inside.withColumns({"__text": F.when(first, opened).otherwise(F.col("chunk")),
                                           "__over": (below & ~first).cast("int"), "__ends": ends.cast("int")}),
                       borders, __closed=F.col("__over"), __done=F.col("__ends"))
    region = counted.where(F.col("__closed") - F.col("__over") == 0)
    grouped = (region.groupBy("__path", (F.col("__done") - F.col("__ends")).alias("__group"))
               .agg(F.array_sort(F.collect_list(F.struct(*_ORDER, "__text"))).alias("__pieces"), F.max("__over").alias("__last"),
                    F.max("__base").alias("__level")))
    text = F.array_join(F.transform("__pieces", lambda p: p["__text"]), "}")
    bare = F.regexp_replace(text, f"^[{WHITESPACE}]+", "")
    bare = F.when(F.col("__group") == 0, bare).when(F.col("__last") == 1, F.regexp_replace(bare, "^,", "")).when(
        bare.startswith(","), bare.substr(F.lit(2), F.length(bare)))
    listed = F.concat(F.lit("["), bare, F.when(F.col("__last") == 1, "").otherwise("}]"))
    blank = (F.col("__level") == 0) & (F.col("__group") > 0) & (F.regexp_replace(text, f"[{WHITESPACE}]+", "") == "")  # behind an object
    records = grouped.where(~blank).select("__path", "__group", F.from_json(listed, "array<string>").alias("__list"))
    broken = F.raise_error(F.concat(F.lit("Invalid JSON document: "), F.col("__path"))).cast("array<string>")
    return records.select("__path", "__group", F.posexplode(F.coalesce("__list", broken)).alias("__pos", "__record"))


# --- CSV -----------------------------------------------------------------------------------------

def csv_records(spark: SparkSession, path: str | Sequence[str], names: Sequence[str], sep: str, ranges: int | None = None) -> DataFrame:
    """(__path, __number, values): the records of CSV files, quoted line breaks included; the header of each file is left out.

    A record begins on a line before which the file holds an even number of quotes.  Quotes within values are doubled.
    """
    lines = chunks_of(spark, path, "\n")
    borders = _borders(lines, ranges)
    quotes = F.length("chunk") - F.length(F.replace("chunk", F.lit('"'), F.lit("")))
    counted = _running(lines.withColumn("__own", quotes), borders, __quotes=F.col("__own"))
    begins = ((F.col("__quotes") - F.col("__own")) % 2 == 0).cast("int")
    numbered = _running(counted.withColumn("__begins", begins), borders, __number=F.col("__begins"))
    whole = (numbered.groupBy("__path", "__number").agg(F.array_sort(F.collect_list(F.struct(*_ORDER, "chunk"))).alias("__lines"))
             .withColumn("__record", F.regexp_replace(F.array_join(F.transform("__lines", lambda x: x["chunk"]), "\n"), "\r$", "")))
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    parsed = F.from_csv("__record", schema, {"sep": sep, "quote": '"', "escape": '"'})
    return (whole.where((F.col("__number") > 1) & (F.col("__record") != "")).select("__path", "__number", parsed.alias("values")))


def read_large_csv(spark: SparkSession, path: str | Sequence[str], sep: str = ",", row_id: str | None = None, ranges: int | None = None) -> DataFrame:
    """S1 for large UTF-8 files with quoted line breaks: header CSV, all values text, many tasks a file."""
    names = (spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("quote", '"').option("escape", '"')
             .option("inferSchema", False).csv(path).columns)
    records = csv_records(spark, path, names, sep, ranges)
    values = [F.coalesce(F.col("values").getField(n), F.lit("")).alias(n) for n in names]
    if not row_id:
        return records.select(*values)
    numbered = with_running(records.withColumn("__one", F.lit(1)), [Key(F.col("__number"))], {"__row": F.col("__one")}, ["__path"])
    return numbered.select(*values, F.col("__row").cast("bigint").alias(row_id))
