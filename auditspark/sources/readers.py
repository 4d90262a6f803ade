"""Exported files and stored tables as DataFrames."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import presets
from ..functions.text import TAIL, WHITESPACE, field, is_populated, ref, strip, text_of
from ..operators.ordering import Key, with_position, with_running
from ..operators.shape import canonical_headers, drop_blank_rows, expand_payload, with_message_ids
from .split import json_elements, read_large_csv

_DOCUMENT = "struct<value:array<string>,records:array<string>>"


def number_rows(df: DataFrame, path: Column, block: Column, name: str = "_Row") -> DataFrame:
    """W1 for files: 1-based ordinal of a row within its file.

    Rows are dealt out by ranges of (file, block, place), so no task sees a whole file.
    ``path`` and ``block`` are the file metadata columns of the scan.
    """
    placed = df.withColumns({"__path": path, "__block": block, "__at": F.monotonically_increasing_id()})
    numbered = with_position(placed, [Key(F.col("__block")), Key(F.col("__at"))], name, ["__path"])
    return numbered.drop("__path", "__block", "__at")


def read_delimited(spark: SparkSession, path: str | Sequence[str], sep: str = ",", encoding: str = "UTF-8",
                   row_id: str | None = None, multi_line: bool = True, large: bool = False) -> DataFrame:
    """Header CSV or text, all values text; quoted line breaks need ``multi_line``.

    Without line breaks inside values, ``multi_line=False`` lets Spark split large files.  ``large`` splits files with such
    line breaks too; they have to be UTF-8 and double the quotes within values.
    """
    if sep not in (",", "\t", ";", "|"):
        raise ValueError("The delimiter must be one of , tab ; |")
    if large:
        if encoding.upper() not in ("UTF-8", "UTF8"):
            raise ValueError("Only UTF-8 files are split at quoted line breaks")
        return read_large_csv(spark, path, sep, row_id)
    df = (spark.read.option("header", True).option("sep", sep).option("multiLine", multi_line)
          .option("quote", '"').option("escape", '"').option("encoding", encoding).option("inferSchema", False)
          .csv(path))
    # A header without a value is a blank, not an absent field.
    values = [F.coalesce(ref(c), F.lit("")).alias(c) for c in df.columns]
    if not row_id:
        return df.select(*values)
    meta = df.select(*values, F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"))
    return number_rows(meta, F.col("__f"), F.col("__b"), row_id).drop("__f", "__b")


def _record_fields(record: Column) -> Column:
    """A JSON record as a MAP of texts; a scalar becomes ``{value: scalar}``; JSON null is blank."""
    as_map = F.from_json(record, "map<string,string>")
    wrapped = F.create_map(F.lit("value"), F.coalesce(F.when(
        record.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), record, F.lit("}")), "$.v")
    ).otherwise(record), F.lit("")))
    chosen = F.when(F.ltrim(record).startswith("{") & as_map.isNotNull(), as_map).otherwise(wrapped)
    return F.transform_values(chosen, lambda _, v: F.coalesce(v, F.lit("")))


_LINE_END = r"\r\n|[\n\r]"


def _fail(*parts: str | Column) -> Column:
    return F.raise_error(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))


def _document_records(doc: Column, path: Column) -> Column:
    """Array of the records of a JSON text; a text that is no single JSON value holds a record on each line."""
    records = "array<string>"
    value = F.try_parse_json(doc)
    members = F.try_variant_get(value, "$", "map<string,variant>")
    holder = F.from_json(doc, _DOCUMENT)

    def held(name: str) -> Column:
        return F.coalesce(holder[name], _fail("JSON input must be an array or contain a value/records array: ", path).cast(records))

    whole = (F.when(doc.startswith("["), F.from_json(doc, records))
             .when(members.isNull(), _fail("JSON input must be an array or contain a value/records array: ", path).cast(records))
             .when(F.map_contains_key(members, "value"), held("value"))
             .when(F.map_contains_key(members, "records"), held("records")).otherwise(F.array(doc)))
    numbered = F.transform(F.split(doc, _LINE_END, -1), lambda line, i: F.struct(strip(line).alias("text"), (i + 1).alias("number")))
    lines = F.transform(F.filter(numbered, lambda line: line["text"] != ""), lambda line: F.when(
        _is_json(line["text"]), line["text"]).otherwise(
        _fail("Invalid JSON on line ", line["number"].cast("string"), " of ", path).cast("string")))
    return F.when(_is_json(doc), whole).otherwise(lines)


def read_json_document(spark: SparkSession, path: str | Sequence[str], row_id: str | None = None,
                       tail: str = TAIL) -> DataFrame:
    """An array, an object that holds a ``value`` or ``records`` array, one object, or a record on each line.

    Anything else fails the job with the file's name, and the line's number where lines are read.  A JSON document is one
    value and cannot be split, so the unit of work is the file; its records leave the reading task at once.  Large files
    of lines are for ``read_json_lines``, which splits them.
    """
    raw = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("__path"), F.btrim("value", F.lit(WHITESPACE + "\ufeff")).alias("doc"))
    rows = raw.filter("doc <> ''").select("__path", F.posexplode(_document_records(F.col("doc"), F.col("__path"))).alias("__pos", "__record"))
    made = rows.select("__path", "__pos", _record_fields(F.col("__record")).alias(tail))
    if row_id:
        made = made.withColumn(row_id, (F.col("__pos") + 1).cast("bigint"))
    return made.drop("__path", "__pos")


def read_large_json(spark: SparkSession, path: str | Sequence[str], row_id: str | None = None, tail: str = TAIL,
                    ranges: int | None = None) -> DataFrame:
    """S2 for large documents: the rows of ``read_json_document``, read by many tasks a file.

    Files of lines are for ``read_json_lines``; here they fail the job like broken documents.
    """
    found = json_elements(spark, path, ranges)
    if row_id:
        sized = found.withColumn("__one", F.lit(1))
        found = with_running(sized, [Key(F.col("__group")), Key(F.col("__pos"))], {row_id: F.col("__one")}, ["__path"])
    own = [ref(row_id).cast("bigint").alias(row_id)] if row_id else []
    return found.select(_record_fields(F.col("__record")).alias(tail), *own)


def _json_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.text(path).select(
        F.col("value").alias("__line"), F.col("_metadata.file_path").alias("__f"),
        F.col("_metadata.file_block_start").alias("__b"))


def _is_json(text: Column) -> Column:
    """Whether a text is one JSON value.  The parser stops after a first value, so the text is put where nothing may follow it."""
    return (F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull()
            & F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull())


def read_json_lines(spark: SparkSession, path: str | Sequence[str], row_id: str | None = None,
                    tail: str = TAIL, strict: bool = True) -> DataFrame:
    """S3: one record per non-blank line; a bad line fails the job with file and number, or is left to ``bad_json_lines``."""
    lines = _json_lines(spark, path).filter(F.btrim("__line", F.lit(WHITESPACE)) != "")
    made = lines.filter(_is_json(F.col("__line"))).withColumn(tail, _record_fields(F.trim("__line")))
    if row_id:
        made = number_rows(made, F.col("__f"), F.col("__b"), row_id)
    made = made.drop("__line", "__f", "__b")
    if not strict:
        return made
    found = bad_json_lines(spark, path)
    error = F.raise_error(F.concat(F.lit("Invalid JSON on line "), F.col("line").cast("string"), F.lit(" of "), F.col("file"))).cast("string")
    failed = found.filter(error.isNotNull())  # a filter, so that no choice of columns leaves it out
    return made.unionAll(failed.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in made.schema.fields]))


def bad_json_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """S3: file, line number and text of the lines that are no JSON.

    Lines are counted per file block; only bad ones meet these counts, so nothing else moves.
    """
    lines = _json_lines(spark, path).withColumn("__at", F.monotonically_increasing_id())
    blocks = lines.groupBy("__f", "__b").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    earlier = Window.partitionBy("__f").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("__f").alias("file"), F.col("__b").alias("__block"), "__first",
                           F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    text = F.col("__line")
    bad = lines.filter((F.btrim(text, F.lit(WHITESPACE)) != "") & ~_is_json(text))
    return (bad.join(blocks, (F.col("__f") == F.col("file")) & (F.col("__b") == F.col("__block")))
            .select("file", (F.col("__before") + F.col("__at") - F.col("__first") + 1).alias("line"), text.alias("text")))


def read_activity(df: DataFrame, payload: str = "AuditData", *, tail: str = TAIL,
                  promote: Sequence[str] = tuple(presets.PROMOTED_COLUMNS)) -> DataFrame:
    """Audit records with their payload taken apart and their message ids listed."""
    raw = F.coalesce(field(df, payload, tail), F.lit(""))
    kept = df.withColumn("__payload", raw)
    wide = expand_payload(kept, payload, tail=tail, promote=promote)
    return with_message_ids(wide, F.col("__payload"), tail=tail).drop("__payload")


def read_trace(df: DataFrame, row_id: str = "_Row") -> DataFrame:
    """Trace rows with canonical headers; blank rows go."""
    return drop_blank_rows(canonical_headers(df), (row_id,))


def load_app_reference(spark: SparkSession, path: str) -> DataFrame:
    """Application ids and names from a JSON object ``{"apps": {id: name}}``."""
    whole = spark.read.text(path, wholetext=True)
    apps = F.from_json("value", "struct<source:string,apps:map<string,string>>")
    return (whole.select(apps.alias("a")).select(F.col("a.source").alias("source"), F.explode("a.apps"))
            .select(F.lower("key").alias("app_id"), F.col("value").alias("name"), "source"))


def load_reference(spark: SparkSession, path: str) -> DataFrame:
    """Stored lookup results, one row per address or domain."""
    return spark.read.parquet(path)


def load_dataset(spark: SparkSession, path: str, case_id: str | None = None,
                 dataset_id: str | None = None) -> DataFrame:
    """Stored rows; only the folders of the case and dataset are opened.

    Their columns come from the notes that ``write_dataset`` leaves, one a dataset.  Where a dataset has none, or two
    disagree on a type, Spark merges the schemas of all files instead.
    """
    inner = ""
    for name, value in (("case_id", case_id), ("dataset_id", dataset_id)):
        if value is None:
            break
        inner += f"/{name}={_escaped(spark, value)}"
    reader = spark.read.option("basePath", path)
    schema = _noted_schema(spark, path, inner)
    df = (reader.option("mergeSchema", True) if schema is None else reader.schema(schema)).parquet(path + inner)
    return df if dataset_id is None or case_id is not None else df.filter(ref("dataset_id") == dataset_id)


def _dataset_folders(spark: SparkSession, store: str, inner: str) -> set[str]:
    """The dataset folders below a store that the path ``inner`` leads to."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{store}{inner}" + "/*=*" * (2 - inner.count("/")))
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return {"/".join(str(f.getPath()).rsplit("/", 2)[1:]) for f in found}


def _noted_schema(spark: SparkSession, path: str, inner: str) -> T.StructType | None:
    """The columns of all datasets together, if every dataset has noted its own and types agree."""
    notes = f"{path}/{presets.SCHEMA_FOLDER}"
    if not inner.startswith("/case_id") and inner:
        return None
    there = _dataset_folders(spark, path, inner)
    if not there or there - _dataset_folders(spark, notes, inner):
        return None
    rows = spark.read.option("basePath", notes).parquet(notes + inner).orderBy("case_id", "dataset_id").select("columns").collect()  # one a dataset
    fields: dict[str, T.StructField] = {}
    for row in rows:
        for f in T.StructType.fromJson(json.loads(row["columns"])).fields:
            known = fields.setdefault(f.name.lower(), T.StructField(f.name, f.dataType))
            if known.dataType != f.dataType:
                return None
    return T.StructType([*fields.values(), T.StructField("case_id", T.StringType()), T.StructField("dataset_id", T.StringType())])


def _escaped(spark: SparkSession, value: str) -> str:
    """A partition value as it is written in folder names."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


def _file_hashes(files: DataFrame) -> DataFrame:
    """(sourcePath, sourceSha256) of files (path): each is read as a stream, so its size does not matter."""
    def digest(batches):
        import hashlib

        import pyarrow as pa
        from pyarrow.fs import FileSystem
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                store, place = FileSystem.from_uri(path)
                state = hashlib.sha256()
                with store.open_input_stream(place, compression=None) as stream:
                    while chunk := stream.read(1 << 22):
                        state.update(chunk)
                found.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["sourcePath", "sourceSha256"])

    return files.select("path").mapInArrow(digest, "sourcePath string, sourceSha256 string")


def dataset_manifest(spark: SparkSession, files: str | Sequence[str], rows: DataFrame, *, file: str = "sourcePath",
                     error: str = "_ParseError") -> DataFrame:
    """Hash and size of every source file beside the counts of its rows, columns and parse errors.

    ``rows`` has the full path of its file in column ``file`` (the scan's ``_metadata.file_path``), which tells files of
    equal names apart.
    """
    found = spark.read.format("binaryFile").load(files)
    sources = found.select(F.col("path").alias("sourcePath"), F.element_at(F.split("path", "/"), -1).alias("sourceFile"),
                           F.col("length").alias("sizeBytes"), F.col("modificationTime").alias("uploadedAt"))
    own = [c for c in rows.columns if c not in (file, error, TAIL)]
    wrong = F.coalesce(field(rows, error), F.lit("")) != ""
    populated = sum((F.max(is_populated(text_of(rows, c)).cast("int")) for c in own), F.lit(0)).cast("bigint")
    counts = rows.groupBy(_plain_path(ref(file)).alias("__path")).agg(
        F.count(F.lit(1)).alias("rowCount"), F.count_if(wrong).alias("parseErrors"), populated.alias("columnCount"))
    return (sources.join(_file_hashes(found), "sourcePath").withColumn("__path", _plain_path(F.col("sourcePath")))
            .join(counts, "__path", "left").drop("__path"))


def _plain_path(path: Column) -> Column:
    """Scans write a local path with one slash after the scheme or with three."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def list_datasets(current: DataFrame, legacy: DataFrame | None = None, newest: str = "uploadedAt") -> DataFrame:
    """Datasets of both manifest shapes, newest first."""
    every = current.withColumn("legacy", F.lit(False))
    if legacy is not None:
        every = every.unionByName(legacy.withColumn("legacy", F.lit(True)), allowMissingColumns=True)
    return every.orderBy(F.desc_nulls_last(newest))


def list_cases(current: DataFrame, legacy: DataFrame | None = None) -> DataFrame:
    """Cases of both manifest shapes, newest first."""
    return list_datasets(current, legacy, "createdAt")
